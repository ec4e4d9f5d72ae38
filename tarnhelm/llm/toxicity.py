"""Toxicity by a classifier chain of linear models.

Categories are predicted in order; each model reads the text's features and the probabilities of the categories before
it. Models are trained on out-of-fold predictions: for training, an earlier category's probability of a document
comes from a model that hasn't seen the document's fold, so that later models meet probabilities as good as they will
be on new texts. Thresholds are set on the out-of-fold predictions as well.

Features are words (lower-cased, split at ASCII characters that are neither digit nor letter) and their prefixes of 4, 5
and 6 bytes, hashed to ``2 ** BITS``, with the value log2(1 + count). A model keeps those whose presence depends on its
category in its training documents (chi-square of ``CHI_SQUARE`` or more).
Models are logistic with an L2 penalty, fitted by full-batch gradient steps on at most ``SAMPLE`` labelled documents, those of
the least hash of doc_id; that is the only bounded part. All documents are scored in one scan.

Defined cases: a null or empty text has no features; its score is the bias, and it is not toxic. Labelled documents
without a text, and labels without a document or with a null label, don't train. Several labels of a document count by
their largest; of the texts with one labelled doc_id the least trains. Without labelled documents all probabilities are 0. Repeated rows return equal rows. Extra columns are
kept by ``drop_toxic`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import STEP_BYTES, pieces

BITS, PREFIXES = 20, (4, 5, 6)
SAMPLE, FOLDS, STEPS, RATE, PENALTY, CHI_SQUARE = 6000, 3, 150, 0.1, 1e-4, 20.0
#: Labels in the order of the chain: name and SQL over the table ``labels``.
CATEGORIES = (("low_quality", "1 - quality"), ("toxic", "toxic"))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), each pair once, by text."""
    data, offsets = W.flat(column)
    data = W.LOWER[data]
    start, end, bounds = W.words(data, offsets, W.ALNUM)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(W.U)
    found = [W.hashes(data, start, end) >> W.U(64 - BITS) | text << W.U(BITS)]
    for n in PREFIXES:
        long = end - start > n
        found.append(W.mix(W.hashes(data, start[long], start[long] + n) + W.U(n)) >> W.U(64 - BITS) | text[long] << W.U(BITS))
    pair, n = np.unique(np.concatenate(found), return_counts=True)
    return (pair >> W.U(BITS)).astype(np.int64), (pair & W.U((1 << BITS) - 1)).astype(np.int64), np.log2(1.0 + n)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", STEP_BYTES):
        text, feature, value = features(batch["text"])
        offsets = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
        kept = [c for c in batch.schema.names if c != "text"]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
        yield pa.RecordBatch.from_arrays([*lists, *(batch[c] for c in kept)], ["features", "values", *kept])


def _slices(n: int, size: int = 1 << 19) -> Iterator[slice]:
    """Parts of n entries, so that what is computed from them is small beside them: training is the driver's."""
    return (slice(a, a + size) for a in range(0, n, size))


class Linear:
    """Logistic regression over sparse features and a few dense ones."""

    def __init__(self, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.weights, self.dense, self.bias = weights, dense, bias

    def probability(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, extra: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(extra))
        for part in _slices(len(row)):
            sums += np.bincount(row[part], self.weights[feature[part]] * value[part], minlength=len(extra))
        return 1 / (1 + np.exp(-np.clip(sums + extra @ self.dense + self.bias, -30, 30)))


def dependent(row: np.ndarray, feature: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """For each feature, whether its chi-square with ``y`` over the rows of ``use`` is large enough."""
    with_positive, with_any = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for part in _slices(len(row)):
        here = use[row[part]]
        used, label = feature[part][here], y[row[part][here]]
        with_positive += np.bincount(used, label, minlength=1 << BITS)
        with_any += np.bincount(used, minlength=1 << BITS)
    n, positive = float(use.sum()), float(y[use].sum())
    expected = n * with_positive - with_any * positive
    below = with_any * (n - with_any) * max(positive * (n - positive), 1.0)
    return n * expected**2 >= CHI_SQUARE * np.maximum(below, 1.0)


def fit_linear(row: np.ndarray, feature: np.ndarray, value: np.ndarray, extra: np.ndarray, y: np.ndarray, use: np.ndarray) -> Linear:
    """use: the rows to train on. Adam over the full batch."""
    rows = len(y)
    kept = dependent(row, feature, y, use)[feature]
    row, value = row[kept], value[kept]
    used, feature = np.unique(feature[kept], return_inverse=True)
    w = np.zeros(len(used) + extra.shape[1] + 1)
    w[-1] = np.log((y[use].sum() + 0.5) / (use.sum() - y[use].sum() + 0.5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    k = len(used)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[:k][feature] * value, minlength=rows) + extra @ w[k:-1] + w[-1]
        slope = np.where(use, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0.0) / max(use.sum(), 1)
        g = np.concatenate([np.bincount(feature, slope[row] * value, minlength=k), slope @ extra, [slope.sum()]])
        g[:-1] += PENALTY * w[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = w[:k]
    return Linear(weights, w[k:-1], float(w[-1]))


class Chain:
    """The models in order, and a threshold for each."""

    def __init__(self, names: list[str], models: list[Linear], thresholds: list[float]):
        self.names, self.models, self.thresholds = names, models, thresholds

    def probabilities(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, 0))
        for model in self.models:
            out = np.hstack([out, model.probability(row, feature, value, out)[:, None]])
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between neighbouring predictions that gives the largest F1; the widest such gap."""
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1))
    below = np.concatenate([p[order][1:], [0.0]])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax((p[order] - below)[best])]
    return float((p[order][k] + below[k]) / 2)


def fit_chain(names: list[str], row: np.ndarray, feature: np.ndarray, value: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> Chain:
    """labels: documents x categories, 0 or 1. A document's fold is a hash of its place."""
    rows = len(labels)
    if not rows:
        return Chain(names, [Linear(np.zeros(1 << BITS), np.zeros(i), -30.0) for i in range(len(names))], [0.5] * len(names))
    fold, extra = (W.mix(np.arange(1, rows + 1, dtype=W.U)) % W.U(folds)).astype(int), np.zeros((rows, 0))  # not in step with the labels' order
    models, thresholds = [], []
    for i in range(len(names)):
        y, out = labels[:, i].astype(float), np.zeros(rows)
        for f in range(folds):
            if (fold == f).any() and (fold != f).any():
                out[fold == f] = fit_linear(row, feature, value, extra, y, fold != f).probability(row, feature, value, extra)[fold == f]
        models.append(fit_linear(row, feature, value, extra, y, np.ones(rows, bool)))
        thresholds.append(best_threshold(out, y))
        extra = np.hstack([extra, out[:, None]])
    return Chain(names, models, thresholds)


def train(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample: int = SAMPLE) -> Chain:
    names = [n for n, _ in categories]
    values = [F.max(F.expr(f"cast({sql} as int)")).alias(f"y{i}") for i, (_, sql) in enumerate(categories)]
    known = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(*values).dropna()
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # at most ``sample`` rows
    ys = [f"y{i}" for i in range(len(names))]
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null").join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id").agg(F.min("text").alias("text"), *(F.first(y).alias(y) for y in ys))  # a document each, however often its id is repeated
    got = texts.mapInArrow(_featured, "features array<int>, values array<float>, id long, " + ", ".join(f"{y} int" for y in ys)).toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    labels = np.stack([got[y].to_numpy()[order] for y in ys], axis=1)
    n = pc.list_value_length(got["features"]).to_numpy().astype(np.int64)
    start = (np.cumsum(n) - n)[order]
    n = n[order]
    at = (np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))).astype(np.int32)
    feature, value = (pc.list_flatten(got[c]).to_numpy()[at] for c in ("features", "values"))
    del got, at
    pa.default_memory_pool().release_unused()
    return fit_chain(names, np.repeat(np.arange(len(n), dtype=np.int32), n), feature, value, labels)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = shared.value
        for batch in pieces(batches, "text", STEP_BYTES):
            row, feature, value = features(batch["text"])
            p = chain.probabilities(row, feature, value, batch.num_rows)
            some = np.bincount(row, minlength=batch.num_rows) > 0
            flag = some & (p[:, -1] >= chain.thresholds[-1])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["doc_key"], *(pa.array(p[:, i]) for i in range(p.shape[1])), pa.array(flag)], ["doc_id", "doc_key", *(f"p_{n}" for n in chain.names), "rejected"])

    return run


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, doc_key, p_<category> ..., rejected (the last category's probability reaches its threshold)."""
    schema = "doc_id long, doc_key long, " + "".join(f"p_{n} double, " for n in chain.names) + "rejected boolean"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    return rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(chain)), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected rows; all columns stay."""
    bad = score(docs, train(docs, labels, **options)).where("rejected").select(F.col("doc_id").alias("_bad_id"), F.col("doc_key").alias("_bad_key")).distinct()
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc_id"), F.xxhash64("doc_id", "text").alias("_doc_key"))
    return packed.join(bad, (packed["_doc_key"] == bad["_bad_key"]) & packed["_doc_id"].eqNullSafe(bad["_bad_id"]), "left_anti").select("_row.*")
