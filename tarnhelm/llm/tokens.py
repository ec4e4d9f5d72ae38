"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

File format. A folder of Parquet files whose rows are blocks of whole documents in ascending doc_id order, and a
folder ``ranks`` with one row for each id of the vocabulary (rank, id). A block has

    shard, block     its place in the order: by shard, then block
    doc_ids, counts  the documents and how many ids each has, the end id included
    control, data    the ranks of all their ids: two bits an id in ``control``, four ids a byte, lowest bits first,
                     hold the number of its bytes less one; ``data`` has these bytes, little-endian

Frequent ids have small ranks: the first 256 take one byte, the next 65,280 two. A decoder looks each control byte up in
numpy tables of 256 entries (four lengths and their sum) and gathers the bytes.

Texts are encoded word by word: the tokenizer's own steps (composition, white space to a space, lower case, split,
byte-level merges) never look across ASCII white space, so a text's ids are those of its white-space-separated words
in order. Nor does it look from an ASCII letter to an ASCII character that is none, where its split always cuts; so words are cut
there as well, and those of ASCII alone are lower-cased, which leaves fewer to encode. Each distinct word of a step is encoded once.
A step in which an added token of the tokenizer stands, whatever its case, has its words encoded as they are.

Defined cases: a null text is an empty one and has the end id alone. Rows with a null doc_id come first. Repeated
doc_ids are neighbours, ordered by their ids' bytes. An empty table makes no blocks. Extra columns aren't read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import drop_path, pieces, scratch_path, written

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Ids in a block at most, unless one document has more.
BLOCK_IDS = 1 << 20
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 2_000_000
#: Words that are given to the tokenizer at once.
TOGETHER = 20_000

_LETTER, _OTHER = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_OTHER[0x21:0x80] = ~_LETTER[0x21:0x80]

BLOCKS = "shard int, block int, doc_ids array<long>, counts array<int>, control binary, data binary"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts; keeps the ids of words that it has seen."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.special = sorted({t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.size = self.tokenizer.get_vocab_size()
        self.known = np.zeros(0, W.U)  # sorted hashes
        self.at = np.zeros(1, np.int64)  # words' ids: ids[at[i]:at[i + 1]]
        self.ids = np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of the words ``texts``."""
        found = [x.ids for i in range(0, len(texts), TOGETHER) for x in self.tokenizer.encode_batch_fast(texts[i : i + TOGETHER], add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def _learn(self, h: np.ndarray, texts: list[str]) -> None:
        ids, n = self._ids(texts)
        if len(self.known) > CACHE_WORDS:
            self.known, self.at, self.ids = np.zeros(0, W.U), np.zeros(1, np.int64), np.zeros(0, np.uint32)
        h, n = np.concatenate([self.known, h]), np.concatenate([np.diff(self.at), n])
        starts, ids = np.cumsum(n) - n, np.concatenate([self.ids, ids])
        order = np.argsort(h, kind="stable")  # two sorted runs
        self.known, self.ids = h[order], ids[_ranges(starts[order], n[order])]
        self.at = np.concatenate([[0], np.cumsum(n[order])])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]]."""
        data, offsets = W.flat(column)
        start, end, bounds = W.words(data, offsets, W.NOT_WHITE)
        low = W.LOWER[data]
        folded = np.zeros(len(start), bool)
        whole = low.tobytes()
        if not any(x in whole for x in self.special):  # an added token is found before any other step
            start, end = cut(data, start, end)
            bounds = np.searchsorted(start, offsets)
            beyond = np.concatenate([[0], np.cumsum(data >= 0x80)])
            folded = beyond[end] == beyond[start]
        hashes = W.hashes(low, start, end)
        hashes[~folded] = W.hashes(data, start[~folded], end[~folded])
        h, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, h)
        new = np.ones(len(h), bool) if not len(self.known) else self.known[np.minimum(place, len(self.known) - 1)] != h
        if new.any():
            if len(self.known) > CACHE_WORDS:
                new[:] = True
            raw = data.tobytes()
            wanted = zip(folded[first[new]].tolist(), start[first[new]].tolist(), end[first[new]].tolist(), strict=True)
            self._learn(h[new], [(whole if f else raw)[a:b].decode("utf-8", "replace") for f, a, b in wanted])
            place = np.searchsorted(self.known, h)
        begin, n = self.at[place][word], np.diff(self.at)[place][word]
        sums = np.concatenate([[0], np.cumsum(n)])
        return self.ids[_ranges(begin, n)], sums[bounds]


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words cut between an ASCII letter and an ASCII character that is none."""
    at = np.flatnonzero(_LETTER[data[:-1]] & _OTHER[data[1:]]) + 1
    first, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    first[start], last[end], first[at], last[at] = True, True, True, True
    return np.flatnonzero(first), np.flatnonzero(last)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0] ... start[0] + n[0] - 1, start[1] ... and so on."""
    total = int(n.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(n) - n), n) if total else np.zeros(0, np.int64)


_encoders: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def _encode(name: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for batch in pieces(batches, "text"):
            ids, bounds = encoder.encode(batch["text"])
            n = batch.num_rows
            at = bounds + np.arange(n + 1)
            out = np.full(int(at[-1]), end_id, "<u4")
            out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(bounds))] = ids
            if encoder.size <= 1 << 16 and end_id < 1 << 16:
                out = out.astype("<u2")
            raw = out.tobytes()
            k = out.itemsize
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([raw[a * k : b * k] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()), pa.array(np.full(n, k, np.int32))], ["doc_id", "ids", "width"])

    return run


def encode_texts(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian, ``width`` bytes each): the text's ids and the end id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(vocabulary, end_id), "doc_id long, ids binary, width int")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw, k in zip(batch["ids"], batch["width"].to_pylist(), strict=True):
            n = np.bincount(np.frombuffer(raw.as_buffer(), f"<u{k}"), minlength=len(total))
            n[: len(total)] += total
            total = n
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])


def ranked(encoded: DataFrame) -> DataFrame:
    """rank, id: ids by falling count, ties by id. It has at most as many rows as the vocabulary."""
    counts = encoded.select("ids", "width").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    got = sorted((-r["n"], r["id"]) for r in counts.collect())
    return encoded.sparkSession.createDataFrame([(i, x) for i, (_, x) in enumerate(got)], "rank long, id long").coalesce(1)


#: For each control byte: the lengths of its four values, and their sum.
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.int64)
SUMS = LENGTHS.sum(axis=1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    v = values.astype("<u4")
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = n - 1
    control = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    keep = np.arange(4) < n[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, total: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:total]
    start = np.cumsum(lengths) - lengths
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    four = np.ndarray((len(raw) - 3,), np.dtype("<u4"), raw, strides=(1,))
    return four[start] & W._MASK[lengths].astype(np.uint32)


def _write(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, shard, block = shared.value, TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list[np.ndarray] = []
        total = 0

        def row() -> pa.RecordBatch:
            control, data = pack(np.concatenate(held))
            cells = [shard, block, doc_ids, [len(x) for x in held], control, data]
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(cells, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, raw, k in zip(batch["doc_id"].to_pylist(), batch["ids"], batch["width"].to_pylist(), strict=True):
                values = rank[np.frombuffer(raw.as_buffer(), f"<u{k}")]
                if held and total + len(values) > BLOCK_IDS:
                    yield row()
                    doc_ids, held, total, block = [], [], 0, block + 1
                doc_ids.append(doc_id)
                held.append(values)
                total += len(values)
        if held:
            yield row()

    return run


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Writes ``docs`` (doc_id, text) to the folder ``path`` in the format above."""
    spark = docs.sparkSession
    encoded = written(encode_texts(docs, vocabulary, end_id), "ids")
    ranks = ranked(encoded)
    got = ranks.toPandas()
    table = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, np.uint32)
    table[got["id"].to_numpy(np.int64)] = got["rank"].to_numpy(np.uint32)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(table)  # four bytes an id of the vocabulary
    placed = encoded.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    placed.mapInArrow(_write(shared), BLOCKS).write.parquet(f"{path}/blocks")
    ranks.write.parquet(f"{path}/ranks")
    drop_path(spark, encoded.inputFiles()[0].rpartition("/")[0]) if encoded.inputFiles() else None


def _read(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for batch in batches:
            for x in batch.to_pylist():
                counts = np.array(x["counts"], np.int64)
                raw = ids[unpack(x["control"], x["data"], int(counts.sum()))].astype("<u4").tobytes()
                stop = np.cumsum(counts) * 4
                each = [raw[b - 4 * n : b] for n, b in zip(counts.tolist(), stop.tolist(), strict=True)]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["shard"]] * n, pa.int32()), pa.array([x["block"]] * n, pa.int32()), pa.array((np.cumsum(counts) - counts)), pa.array(x["doc_ids"], pa.int64()), pa.array(counts), pa.array(each, pa.binary()), pa.array([zlib.crc32(y) for y in each], pa.int64())],
                    ["shard", "block", "within", "doc_id", "n_tokens", "ids", "ids_crc32"],
                )

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit), ids_crc32 of a written folder."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    got = spark.read.schema("rank long, id long").parquet(f"{path}/ranks").toPandas().sort_values("rank")
    shared = spark.sparkContext.broadcast(got["id"].to_numpy(np.uint32) if len(got) else np.zeros(1, np.uint32))
    # Ids before each block: within its shard, and in the shards before; shards are as many as tasks have written.
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    sizes = blocks.select("shard", "block", total.alias("total"))
    shards, sums = {}, 0
    for r in sorted(sizes.groupBy("shard").agg(F.sum("total").alias("n")).collect(), key=lambda r: r["shard"]):
        shards[r["shard"]], sums = sums, sums + r["n"]
    before = spark.createDataFrame(list(shards.items()), "shard int, shard_start long")
    from pyspark.sql import Window

    order = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("in_shard", F.coalesce(F.sum("total").over(order), F.lit(0).cast("long"))).join(before, "shard")
    rows = blocks.mapInArrow(_read(shared), "shard int, block int, within long, doc_id long, n_tokens long, ids binary, ids_crc32 long")
    return rows.join(starts.select("shard", "block", (F.col("shard_start") + F.col("in_shard")).alias("block_start")), ["shard", "block"]).select("doc_id", (F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write(docs, path, vocabulary, end_id)
    return read(spark, path)
