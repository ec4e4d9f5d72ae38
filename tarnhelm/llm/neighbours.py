"""Approximate nearest neighbours by additive quantisation, nearest by the largest inner product.

Index. A vector is the sum of one word from each of ``BOOKS`` codebooks, all of full dimension. Codebooks start as k-means of
the residuals of a bounded, documented sample (the ``SAMPLE`` vectors of the least hash) and are then refitted in turn to what the
others leave. Encoding is a beam search: ``BEAM`` sums are kept from codebook to codebook. The index holds every vector's codes, one
byte a codebook, and the squared norm of its sum.

Search. A query's inner products with all words are a table of 256 entries a codebook; a vector's score is the sum of the entries at its
codes (for Euclidean distance, twice that less the stored norm). Queries go in blocks of ``QUERY_BLOCK``, whose size bounds
the broadcast; each block is scored against all vectors, in steps. The best ``RERANK`` go on to exact scores
in double precision on the original vectors.

Equal vectors are one entry of the index with their least ids, as many as an answer can hold, so copies of one
vector can't crowd out others.

Defined cases: rows whose vec_id or vector is null, whose vector is empty, zero, or holds a null or non-finite number, take no
part; nor do those of another dimension than most (of the least one among the commonest). A repeated vec_id counts once, with
its least vector. With fewer than k candidates all are returned; ties go to the smaller vec_id. An empty table gives an empty
result. Extra columns aren't read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BOOKS, WORDS, BEAM, SAMPLE, RERANK, QUERY_BLOCK, PIECE = 16, 256, 4, 8192, 800, 4096, 262_144
ENCODE_ROWS, SWEEPS, LEAST_BLOCK = 2048, 3, 256


class Codebooks:
    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)  # codebook x word x dimension
        self.norms = np.einsum("mkd,mkd->mk", self.books, self.books)

    def __reduce__(self):
        return Codebooks, (self.books,)

    @functools.cached_property
    def dots(self) -> np.ndarray:
        """Inner products of all words; only encoding needs them."""
        flat = self.books.reshape(-1, self.books.shape[2])
        m, k, _ = self.books.shape
        return (flat @ flat.T).reshape(m, k, m, k)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes, vector x codebook: of the sums that a beam search keeps, the nearest."""
        x = x.astype(np.float32)
        n, (m, k, _) = len(x), self.books.shape
        error, codes = np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.uint8)
        for i in range(m):
            # |r - c|^2 - |r|^2 with r = x - chosen words: |c|^2 - 2 x.c + 2 (chosen words).c
            gain = np.repeat((self.norms[i] - 2 * (x @ self.books[i].T))[:, None, :], error.shape[1], axis=1)
            for j in range(i):
                gain += 2 * self.dots[j][codes[:, :, j], i]
            total = (error[:, :, None] + gain).reshape(n, -1)
            keep = min(beam, total.shape[1])
            best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
            error = np.take_along_axis(total, best, axis=1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], axis=1), (best % k)[:, :, None].astype(np.uint8)], axis=2)
        return codes[np.arange(n), error.argmin(axis=1)]

    def sums(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[i][codes[:, i]] for i in range(len(self.books)))


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows; a centre without rows takes the row farthest from its own."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        distance = (centres * centres).sum(axis=1) - 2 * x @ centres.T
        own = distance.argmin(axis=1)
        count = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        some = np.flatnonzero(count)
        centres[some] = np.add.reduceat(x[order], (np.cumsum(count) - count)[some]) / count[some, None]
        far = np.argsort(-(distance[np.arange(len(x)), own] + (x * x).sum(axis=1)), kind="stable")
        centres[count == 0] = x[far[: (count == 0).sum()]] if len(x) >= k else centres[count == 0]
    return centres


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS) -> Codebooks:
    rest, found = sample.astype(np.float32), []
    for _ in range(books):
        centres = _means(rest, words)
        found.append(centres)
        rest = rest - centres[((centres * centres).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)]
    made = Codebooks(np.stack(found))
    # Codebooks anew for the codes of the beam search, one after another: each word is the mean of what the others leave of its vectors.
    codes = np.concatenate([made.encode(sample[i : i + ENCODE_ROWS]) for i in range(0, len(sample), ENCODE_ROWS)])
    fitted = made.books.copy()
    rest = sample.astype(np.float32) - made.sums(codes)
    for _ in range(SWEEPS):
        for i in range(books):
            rest += fitted[i][codes[:, i]]
            n = np.bincount(codes[:, i], minlength=words)
            order, some = np.argsort(codes[:, i], kind="stable"), np.flatnonzero(n)
            fitted[i][some] = np.add.reduceat(rest[order], (np.cumsum(n) - n)[some]) / n[some, None]
            rest -= fitted[i][codes[:, i]]
    return Codebooks(fitted)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _encoder(shared, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(i, ENCODE_ROWS)
                codes = books.encode(_matrix(part["vector"], dimension))
                sums = books.sums(codes)
                raw = codes.tobytes()
                yield pa.RecordBatch.from_arrays([part["vid"], pa.array([raw[j : j + codes.shape[1]] for j in range(0, len(raw), codes.shape[1])], pa.binary()), pa.array((sums * sums).sum(axis=1), pa.float32())], ["vid", "codes", "norm"])

    return run


def _searcher(shared, rerank: int, metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, query_ids, queries = shared.value
        m, k, _ = books.books.shape
        tables = np.einsum("qd,mkd->qmk", queries, books.books).astype(np.float32)
        best = np.zeros((len(queries), 0), np.float32)
        ids = np.zeros((len(queries), 0), np.int64)
        for batch in batches:
            vids = batch["vid"].to_numpy()
            codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(-1, m)
            norms = batch["norm"].to_numpy()
            kept, kept_ids = [], []
            for a in range(0, len(queries), 64):  # bounds the scores held at once
                score = tables[a : a + 64, 0][:, codes[:, 0]]
                for i in range(1, m):
                    score += tables[a : a + 64, i][:, codes[:, i]]
                if metric == "euclidean":
                    score = 2 * score - norms  # less the query's own norm, which is the same for all
                score = np.hstack([best[a : a + 64], score])
                every = np.hstack([ids[a : a + 64], np.broadcast_to(vids, (len(score), len(vids)))])
                if score.shape[1] > rerank:
                    top = np.argpartition(-score, rerank - 1, axis=1)[:, :rerank]
                    score, every = np.take_along_axis(score, top, axis=1), np.take_along_axis(every, top, axis=1)
                kept.append(score)
                kept_ids.append(every)
            best, ids = np.vstack(kept), np.vstack(kept_ids)
        n = best.shape[1]
        for a in range(0, len(queries) if n else 0, 256):
            part = slice(a, a + 256)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids[part], n)), pa.array(ids[part].reshape(-1)), pa.array(best[part].reshape(-1))], ["query_id", "vid", "near"])

    return run


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part, one a vec_id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where("vec_id is not null and size(vector) > 0").where(F.forall("vector", fine) & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _least_ids(k: int):
    """Equal vectors of a task become one row with their k + 1 least ids, before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["vec_id"].to_numpy()
            raw = [x.values.to_numpy(zero_copy_only=False).tobytes() for x in batch["vector"]]
            held: dict[bytes, list[int]] = {}
            for i in np.argsort(ids, kind="stable").tolist():
                own = held.setdefault(raw[i], [])
                if len(own) <= k:
                    own.append(i)
            rows = pa.array([x[0] for x in held.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["vector"].take(rows), pa.array([[int(ids[i]) for i in x] for x in held.values()], pa.list_(pa.int64()))], ["vector", "ids"])

    return run


def search(vectors: DataFrame, is_query, k: int = 20, rerank: int = RERANK, metric: str = "inner") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row for which ``is_query`` (a column over vec_id) holds. score is the inner product, or with ``metric`` euclidean the negative squared distance."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    valid = written(_valid(vectors), "vectors")
    sizes = valid.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dimension = sizes["d"]
    valid = valid.where(F.size("vector") == dimension)
    some = valid.mapInArrow(_least_ids(k), "vector array<double>, ids array<long>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    least = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k + 1)
    entries = some.groupBy("vector", "salt").agg(least("ids").alias("ids")).groupBy("vector").agg(least("ids").alias("ids"))
    entries = written(entries.select(F.element_at("ids", 1).alias("vid"), "ids", "vector"), "entries")
    total = entries.count()
    sample = entries.select("vid", "vector").orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).toArrow()["vector"].combine_chunks()
    books = train(_matrix(sample, dimension))
    shared = spark.sparkContext.broadcast(books)
    index = written(entries.select("vid", "vector").mapInArrow(_encoder(shared, dimension), "vid long, codes binary, norm float"), "index")
    pieces = max(1, math.ceil(total / PIECE))
    queries = valid.where(is_query)
    asked = queries.count()
    # A block bounds what is broadcast; fewer queries are dealt into smaller ones, so that all cores have some.
    n_blocks = max(1, math.ceil(asked / QUERY_BLOCK * 1.2), min(spark.sparkContext.defaultParallelism, math.ceil(asked / LEAST_BLOCK)))
    found = None
    for b in range(n_blocks):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toArrow()  # about QUERY_BLOCK rows
        if not block.num_rows:
            continue
        sent = spark.sparkContext.broadcast((books, block["vec_id"].to_numpy(), _matrix(block["vector"].combine_chunks(), dimension)))
        near = index.coalesce(pieces).mapInArrow(_searcher(sent, rerank, metric), "query_id long, vid long, near float")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], schema)
    first = Window.partitionBy("query_id").orderBy(F.desc("near"), "vid")
    chosen = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= rerank).select("query_id", "vid")
    both = chosen.join(entries, "vid").join(queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")), "query_id")
    term = (lambda x, y: -(x - y) * (x - y)) if metric == "euclidean" else (lambda x, y: x * y)
    exact = F.aggregate(F.zip_with("q", "vector", term), F.lit(0.0), lambda s, x: s + x)
    scored = both.select("query_id", exact.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
