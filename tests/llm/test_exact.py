"""Operators whose results are exact, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from .conftest import SCHEMA, rows

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_words_and_hashes_match_the_patterns():
    import pyarrow as pa

    from tarnhelm.llm import words as W

    texts = ["héllo  Wörld", None, "", "\tx\x0by ", "a" * 40 + " b", "hello hello", "tail"]
    data, offsets = W.flat(pa.array(texts).slice(1))
    start, end, bounds = W.words(data, offsets, W.NOT_WHITE)
    found = [[bytes(data[a:b]).decode() for a, b in zip(start[i:j], end[i:j])] for i, j in zip(bounds[:-1], bounds[1:])]
    assert found == [WHITE.findall(t or "") for t in texts[1:]]
    h = W.hashes(data, start, end)
    words = [w for x in found for w in x]
    assert len(set(h.tolist())) == len(set(words))
    runs = W.Runs(h)
    assert runs.of(np.array([3]), np.array([4])) != runs.of(np.array([0]), np.array([1]))
    assert W.run_starts(bounds, 2).tolist() == [i for i in range(len(words) - 1) if any(bounds[k] <= i and i + 2 <= bounds[k + 1] for k in range(len(bounds) - 1))]


def brute_windows(documents, items, width=10):
    windows: dict = {}
    for name, text in items:
        w = ALNUM.findall((text or "").translate(LOW))
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(name)
    for doc_id, text in documents:
        w = ALNUM.findall((text or "").translate(LOW))
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= found
        ids = sorted(x for x in names if x is not None)
        yield doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_decontamination(spark, docs, wide, empty, block_words):
    from tarnhelm.llm import decontaminate as D

    documents = [(r[0], r[1]) for r in rows()]
    texts = [t for _, t in documents if t]
    items = [("1", " ".join(texts[0].split()[5:25])), ("2", "ONE, two"), ("3", None), ("4", ""), ("1", " ".join(texts[0].split()[5:25])), (None, " ".join(texts[2].split()[:12])), ("5", " ".join(texts[0].split()[12:30]) + " more words here")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = [tuple(r) for r in D.report(D.find_hits(wide, benchmark, block_words=block_words)).collect()]
    key = lambda x: (x[0] is None, x)
    assert Counter(got) == Counter(brute_windows(documents, items))
    assert D.find_hits(empty, benchmark).count() == 0
    assert not any(r.contaminated for r in D.report(D.find_hits(docs, benchmark.limit(0))).collect())
    if block_words > 20:
        kept = D.drop_contaminated(wide, benchmark)
        assert kept.columns == wide.columns
        assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(g[0] or -1 for g in got if not g[5])
    assert key is not None


def test_token_files_round_trip(spark, wide, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tarnhelm.llm import tokens as T

    extra = [(800, "mixed <|endoftext|> CASE nbsp é é ２ ½ 'll", "en", "s", 1), (801, "x<|startoftext|>y 👍👍 ab c", "en", "s", 1)]
    table = wide.select(*SCHEMA_NAMES).unionByName(spark.createDataFrame(extra, SCHEMA))
    tokenizer = Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    expected, start = [], 0
    made = [(d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, t, *_ in rows() + extra]
    small = lambda x: (x[0] is not None, x[0] or 0, np.frombuffer(x[1], "<u4").astype("<u2").tobytes())
    for doc_id, raw in sorted(made, key=small):
        expected.append((doc_id, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    got = [tuple(r) for r in T.round_trip(table).drop("ids").collect()]
    assert Counter(got) == Counter(expected)
    assert T.round_trip(empty).count() == 0


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def test_variable_length_code():
    from tarnhelm.llm import tokens as T

    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert (T.unpack(*T.pack(values), n) == values).all()


def brute_repeats(documents, width=20):
    seen = set()
    order = sorted(range(len(documents)), key=lambda i: (documents[i][0] is None, documents[i][0] or 0))
    out = {}
    for i in order:
        w = WHITE.findall(documents[i][1] or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            if x in seen:
                gone[k : k + width] = [True] * width
            seen.add(x)
        kept = " ".join(a for a, b in zip(w, gone) if not b)
        out[i] = (documents[i][0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return [out[i] for i in range(len(documents))]


def test_substring_dedup(spark, wide, empty):
    from tarnhelm.llm import substrings as S

    unique = [r for r in dict.fromkeys(rows()) if r[0] is not None]  # repeated rows are one document
    got = S.dedup(spark.createDataFrame(unique, SCHEMA)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(brute_repeats(unique))
    assert S.dedup(wide).count() == len(rows())
    assert S.dedup(empty).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_substring_dedup_of_periodic_and_random_texts(spark, seed):
    from tarnhelm.llm import substrings as S

    rng = random.Random(seed)
    parts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(3, 30))) for _ in range(8)]
    documents = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 6)))) for i in range(40)] + [(90, "x " * 100), (91, "x y " * 60)]
    got = S.dedup(spark.createDataFrame(documents, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(brute_repeats(documents))


def test_mixing_meets_budgets(spark, wide, empty):
    from tarnhelm.llm import mixing as M

    got = M.allot(wide).collect()
    assert len(got) == len(rows())
    size, source = Counter(), {}
    for r in rows():
        size[r[3]] += len(WHITE.findall(r[1] or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, left = {}, float(sum(size.values()))
    while True:
        some = [s for s in names if s not in target]
        level = left / sum(weight[s] for s in some)
        over = [s for s in some if weight[s] * level > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
    target |= {s: weight[s] * level for s in some}
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(x, 6) for x in target.values()})
    assert abs(sum(r.taken for r in got) - sum(size.values())) <= len(names)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert Counter(map(tuple, got)) == Counter(map(tuple, M.allot(wide).collect()))
    assert M.allot(empty).count() == 0
    mixed = M.mix(wide)
    assert mixed.columns == wide.columns
    total = sum(len(WHITE.findall(r.text or "")) for r in mixed.collect())
    assert abs(total - sum(size.values())) < 0.5 * 4000 + 200  # half of the longest document
    assert source == {}


def test_base_patterns_equal_plain_regexes(spark, wide, empty):
    from tarnhelm.llm import pii

    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    fine = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    rng = random.Random(3)
    texts = ["".join(rng.choice("a1.@+- ()2-5%é\n") for _ in range(rng.randrange(50))) for _ in range(3000)] + ["call +1 (555) 123-4567, x.y@z.co.uk 4539 1488 0343 6467 10.0.0.255.1.2.3.4"]
    for t in texts:
        assert pii.base_spans(t) == [(k, *m.span()) for k, p in plain.items() for m in re.finditer(p, t) if fine[k](m.group())]
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []  # linear
    assert pii.find_spans(wide).count() == len(rows())
    assert pii.find_spans(empty).count() == 0


def test_revealing_terms_are_generalised(spark):
    from tarnhelm.llm import pii

    rng = random.Random(5)
    filler = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6))
    texts = [(i, f"{filler()} zanzibar {filler()[:5]} mail bob@example.org {filler()}") for i in range(5)] + [(10 + i, filler() * 3) for i in range(30)] + [(99, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    terms = {texts[0][1][s.begin : s.end] for s in found[0].spans if s.kind == "term"}
    assert "zanzibar" in terms and not terms & {"alpha", "beta", "gamma", "delta"}
    assert found[10].spans == []
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "zanzibar" not in clean[0] and "bob@" not in clean[0] and "[EMAIL]" in clean[0] and clean[99] is None and clean[12] == texts[7][1]


def test_revealing_terms_far_from_a_mention_are_generalised(spark):
    from tarnhelm.llm import pii

    rng = random.Random(8)
    filler = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    # The name opens each document and the address ends it; in two of them it is also near.
    texts = [(i, f"Quillon {filler(40)} {'quillon ' if i < 2 else ''}mail bob@example.org") for i in range(4)] + [(10 + i, filler(30)) for i in range(60)]
    texts += [(90, "quillon alone"), (90, "quillon alone")]  # one document, without the entity
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find_spans(docs).collect()}
    for i in range(4):
        terms = [(s.begin, texts[i][1][s.begin : s.end].lower()) for s in found[i] if s.kind == "term"]
        assert [t for t in terms if t[1] == "quillon"] == [(m.start(), "quillon") for m in re.finditer("quillon", texts[i][1].lower())]
        assert not {t for _, t in terms} & {"alpha", "beta", "gamma", "delta"}
    assert found[90] == []
    assert all("quillon" not in r.text.lower() for r in pii.sanitise(docs).where("doc_id < 4").collect())
    # p(entity | term) = 4/5 over 65 documents: with the repeated row counted twice it would be 4/6.
    limit = lambda p: 1 - math.log(p) / math.log(4 / 65)
    marked = lambda p: any(s.kind == "term" and s.begin == 0 for r in pii.find_spans(docs, disclosure=limit(p)).collect() for s in r.spans if r.doc_id == 0)
    assert marked(0.79) and not marked(0.81)


@pytest.mark.parametrize(("support", "disclosure"), [(1, 0.9), (2, 0.7), (1, 0.4)])
def test_term_spans_equal_brute_force(spark, support, disclosure):
    """PMI by documents from its definition; rows with the same doc_id and text are one document."""
    from tarnhelm.llm import pii

    rng = random.Random(21)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    table = []
    for i in range(80):
        words = [rng.choice(vocabulary[: rng.choice([10, 30, 60])]) for _ in range(rng.randrange(1, 25))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            words.insert(rng.randrange(len(words)), rng.choice(["a@b.org", "A@b.org", "c@d.com", "10.0.0.1", f"x{i}@y.net"]))
        table += [(rng.choice([i, i, None]), " ".join(words))] * rng.choice([1, 1, 3])
    table += [(500 + i, table[i][1]) for i in range(10)]
    documents = set(table)
    plain = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    facts = []
    for doc_id, text in documents:
        base = pii.base_spans(text)
        free = [m.span() for m in plain.finditer(text.lower()) if m.end() - m.start() >= 3 and all(m.end() <= a or m.start() >= b for _, a, b in base)]
        facts.append(({text[a:b].lower() for _, a, b in base}, set(plain.findall(text.lower())), {text[a:b].lower() for a, b in free}, doc_id, text, base, free))
    n = len(documents)
    expected = {}
    for entities, _, own, doc_id, text, base, free in facts:
        marked = set()
        for e in entities:
            with_e = [f for f in facts if e in f[0]]
            for t in own:
                both, alone = sum(t in f[2] for f in with_e), sum(t in f[1] for f in facts)
                pmi = math.log(both / n / (len(with_e) / n * alone / n))
                if len(with_e) >= support and both >= support and pmi >= disclosure * -math.log(len(with_e) / n) - 1e-12:
                    marked.add(t)
        spans = [*base, *(("term", a, b) for a, b in free if text[a:b].lower() in marked)]
        expected[doc_id, text] = spans
    docs = spark.createDataFrame(table, "doc_id long, text string")
    by_digest = {(d, hashlib.md5(t.encode()).digest()): s for (d, t), s in expected.items()}
    got = [((r.doc_id, bytes(r.text_key)), [(s.kind, s.begin, s.end) for s in r.spans]) for r in pii.find_spans(docs, support, disclosure).collect()]
    assert len(got) == len(table) and all(by_digest[k] == s for k, s in got)
    assert any(k == "term" for _, s in got for k, _, _ in s)
