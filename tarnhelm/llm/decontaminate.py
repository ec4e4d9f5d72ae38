"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all benchmark items.

Texts are normalised by lower-casing A-Z and splitting at ASCII characters that are neither digit nor letter. An
item of ``width`` words or more gives every run of ``width`` consecutive words, a shorter one (but not an empty
one) itself. The automaton reads word numbers, one pass over a text; a hit's words map back to the original text
through the words' offsets.

Defined cases: a null or empty text has no words, no hits, and is clean. Items that are null or empty have no
window. Items with a null item_id are found and mark words, but no id is listed for them. Repeated rows are each
scanned and return equal rows; repeated items count once by id. An empty benchmark leaves all documents clean.
Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import pieces, written

WIDTH = 10
#: Words of benchmark text in one automaton. A larger benchmark is cut into blocks of items, each with its own
#: automaton and its own pass; this bounds what is sent to executors, not what is found.
BLOCK_WORDS = 1_000_000

HITS = "doc_id long, doc_key long, n_words long, first array<int>, last array<int>, begin array<int>, end array<int>, items array<string>"


def _windows(texts: list[str | None], ids: list[str | None], width: int) -> dict[tuple[int, ...], set]:
    """Windows as word hashes (64 bits), with the ids of the items that have them."""
    data, offsets = W.flat(pa.array(texts, pa.string()))
    data = W.LOWER[data]
    start, end, bounds = W.words(data, offsets, W.ALNUM)
    h = W.hashes(data, start, end).tolist()
    out: dict[tuple[int, ...], set] = {}
    for i, name in enumerate(ids):
        a, b = int(bounds[i]), int(bounds[i + 1])
        for k in range(a, max(a, b - width) + 1) if b > a else ():
            out.setdefault(tuple(h[k : min(k + width, b)]), set()).add(name)
    return out


class Automaton:
    """Windows as an Aho-Corasick automaton over word numbers; 0 is any word that no item has."""

    def __init__(self, texts: list[str | None], ids: list[str | None], width: int):
        import ahocorasick

        windows = _windows(texts, ids, width)
        self.vocabulary = np.array(sorted({x for w in windows for x in w}), dtype=W.U)
        self.shortest = min(map(len, windows), default=0)
        number = {x: i + 1 for i, x in enumerate(self.vocabulary.tolist())}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, items in windows.items():
            self.machine.add_word(tuple(number[x] for x in window), (len(window), items))
        if windows:
            self.machine.make_automaton()

    def numbers(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)

    def scan(self, h: np.ndarray, bounds: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set]]:
        """For each text with hits: (first word, word after the last) of each, and the ids of their items."""
        if not len(self.vocabulary) or not len(h):
            return {}
        n = self.numbers(h)
        # The machine is back at its root after a word that no item has: it reads only runs of known words that are long enough.
        known = np.concatenate([[False], n > 0, [False]])
        known_at = np.flatnonzero(known[1:] != known[:-1])
        out: dict[int, tuple[list, set]] = {}
        for a, b in zip(known_at[::2].tolist(), known_at[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            text = int(np.searchsorted(bounds, a, side="right")) - 1
            while a < b:  # a run may go on in the next texts
                stop = min(b, int(bounds[text + 1]))
                if stop - a >= self.shortest:
                    for last, (length, items) in self.machine.iter(tuple(n[a:stop].tolist())):
                        spans, names = out.setdefault(text, ([], set()))
                        e = a + last + 1 - int(bounds[text])
                        spans.append((e - length, e))
                        names |= items
                a, text = max(a, stop), text + 1
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_built: dict[str, Automaton] = {}


def _automaton(texts: list, ids: list, width: int) -> Automaton:
    """One build a worker process; the digest names the block, so a reused worker can't take another's."""
    key = hashlib.sha256(repr((texts, ids, width)).encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(texts, ids, width)
    return _built[key]


def _scanner(block, width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(*block.value, width)
        for batch in pieces(batches, "text"):
            data, offsets = W.flat(batch["text"])
            data = W.LOWER[data]
            start, end, bounds = W.words(data, offsets, W.ALNUM)
            found = machine.scan(W.hashes(data, start, end), bounds)
            columns: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                spans, names = found.get(i, ((), ()))
                spans, base = merged(spans), int(bounds[i])
                columns[0].append([a for a, _ in spans])
                columns[1].append([b for _, b in spans])
                columns[2].append([int(start[base + a] - offsets[i]) for a, _ in spans])
                columns[3].append([int(end[base + b - 1] - offsets[i]) for _, b in spans])
                columns[4].append(sorted(x for x in names if x is not None))
            kinds = [pa.list_(pa.int32())] * 4 + [pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["doc_key"], pa.array(np.diff(bounds)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "doc_key", "n_words", "first", "last", "begin", "end", "items"],
            )

    return scan


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document: its words, the merged runs of hit words (first:last by word, begin:end by byte of the UTF-8 text), the items.

    The benchmark's text is measured first. Up to ``block_words`` it is one automaton and one scan. Beyond, items are
    dealt by hash into blocks; each block scans all documents and the blocks' hits are united per row.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("body")).where(F.col("body").isNotNull())
    total = items.agg(F.sum(F.length("body") / 2)).first()[0] or 0  # a word and its separator have two characters at least
    n = max(1, -(-int(total) // block_words))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    out = []
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "body"), F.lit(n)) == i)
        got = sorted({(r["id"], r["body"]) for r in part.collect()}, key=lambda x: (x[0] or "", x[1]))
        block = spark.sparkContext.broadcast(([b for _, b in got], [a for a, _ in got]))
        out.append(rows.mapInArrow(_scanner(block, width), HITS))
    if n == 1:
        return out[0]
    several = out[0]
    for x in out[1:]:
        several = several.unionByName(x)
    # Rows with equal id and text have equal keys and equal hits: one row of the union stands for them, and its number of copies is kept.
    spans = F.arrays_zip("first", "last", "begin", "end")
    several = written(several.select("doc_id", "doc_key", "n_words", "items", spans.alias("spans")), "hits")
    united = several.groupBy("doc_id", "doc_key").agg(
        F.max("n_words").alias("n_words"), (F.count("*") / n).cast("int").alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"),
    )
    # Merge overlapping runs with a fold over the sorted spans.
    folded = F.expr(
        """aggregate(spans, cast(array() as array<struct<first:int,last:int,begin:int,end:int>>), (acc, x) ->
             CASE WHEN size(acc) > 0 AND x.first <= element_at(acc, -1).last
                  THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, 'last', greatest(element_at(acc, -1).last, x.last),
                              'begin', element_at(acc, -1).begin, 'end', greatest(element_at(acc, -1).end, x.end))))
                  ELSE concat(acc, array(named_struct('first', x.first, 'last', x.last, 'begin', x.begin, 'end', x.end))) END)"""
    )
    united = united.withColumn("m", folded).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return united.select("doc_id", "doc_key", "n_words", F.col("m.first").alias("first"), F.col("m.last").alias("last"), F.col("m.begin").alias("begin"), F.col("m.end").alias("end"), "items")


def report(hits: DataFrame) -> DataFrame:
    """The counts and digests of ``find_hits``."""
    n_hit = F.coalesce(F.aggregate(F.zip_with("first", "last", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; all columns stay."""
    bad = find_hits(docs, benchmark, width).where(F.size("first") > 0).select(F.col("doc_id").alias("_bad_id"), F.col("doc_key").alias("_bad_key")).distinct()
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc_id"), F.xxhash64("doc_id", "text").alias("_doc_key"))
    return packed.join(bad, (packed["_doc_key"] == bad["_bad_key"]) & packed["_doc_id"].eqNullSafe(bad["_bad_id"]), "left_anti").select("_row.*")
