from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ("_row", "key", "bucket", "size", "target", "held", "doc_key", "component")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lam", "mu"]) + str(rng.randrange(30)) for _ in range(n))


def rows() -> list[tuple]:
    """Nulls in every column, empty texts, repeated rows, copies, near copies, shared passages, one long text."""
    rng = random.Random(7)
    base = [sentence(rng, rng.randrange(30, 120)) for _ in range(24)]
    passage = sentence(rng, 40)
    out = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    out += [(100 + i, base[i], "en", "s0", 1) for i in range(4)]  # exact copies
    out += [(200 + i, base[i + 5] + " changed", "en", "s1", 1) for i in range(3)]  # near copies
    out += [(300 + i, sentence(rng, 15) + " " + passage + "\n" + sentence(rng, 9), "de", None, 1) for i in range(3)]
    out += [(400, None, None, None, None), (401, "", "en", "s2", 0), (402, " \t\n", "en", "s2", 3), (None, base[3], "en", "s1", 1), (None, None, None, None, None)]
    out += [(500, base[8], "en", "s1", 1)] * 2  # a repeated row
    out += [(600, "one two", "en", "s2", 7), (601, "A!b c", "en", "s2", 5), (700, sentence(rng, 4000), "en", "s0", 1)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(docs):
    """The same with extra columns of clashing names."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in CLASHING})
