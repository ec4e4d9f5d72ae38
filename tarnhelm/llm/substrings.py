"""Substring dedup by seed and extend, exact for runs of ``width`` words.

Seeds. Of the word ``ANCHOR``-grams that a window of ``width`` words holds, the least (by hash, then leftmost) is the
window's anchor: winnowing. Equal windows have equal anchors at equal places, so any repeat of ``width`` words or more
shares an anchor, and only about one word in nine is one. The windows of a text fall into units, one an anchor:
the run of neighbouring windows that chose it.

Extend. Anchors with the same hash are joined across documents (after those that occur once have gone) and
extended both ways as far as any of their windows reaches, which is their unit. Units with equal words are
maximal repeats of their anchor: every occurrence but the first in order is a repeat as a whole. The first
occurrences of different units with the same anchor differ somewhere; they are extended a window at a time, to
find those windows that both hold.

A window repeats if its words also start at a smaller (doc_id, place). Its first occurrence is within the first
occurrence of some unit, so comparing first occurrences loses nothing. No pairs of documents are made and no group is
gathered: each step takes a minimum by key, which is combined before it is shuffled, or joins on the anchor. So a match is extended
against the first occurrence only, not pair by pair: pairs of n documents with a passage would be n ** 2 / 2.

Units and windows are compared by 64-bit hashes of their words. Two unequal ones of n share a hash with probability n ** 2 / 2 ** 65:
about 3e-6 at 1e7 windows; of the 1e13 windows of 100 TB some millions would, one in 4 million.

Defined cases: null and empty texts have no words. Order is by doc_id, null last, then by a hash of the text; rows
equal in both are one document and get equal results. Texts under ``width`` words stay whole. An empty
table gives an empty result. Extra columns aren't read.
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

WIDTH, ANCHOR = 20, 5
LAST = (1 << 63) - 1  # the order of a null doc_id

UNITS = "doc long, part int, pos int, n int, anchor long, unit long"


def _anchors(h: np.ndarray, bounds: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, W.Runs]:
    """(start, n, anchor hash, unit hash) of each unit, and the runs: a unit's windows start at start ... start + n - 1."""
    runs = W.Runs(h)
    at = W.run_starts(bounds, width)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, runs
    every = np.arange(len(h) - k + 1)
    best, where = runs.of(every, every + k), every
    grams = best
    span, need = 1, width - k + 1
    while span < need:  # minimum over ``need`` neighbours, by doubling; the left one wins a tie
        step = min(span, need - span)
        right = best[step:] < best[:-step]
        where = np.where(right, where[step:], where[:-step])
        best = np.where(right, best[step:], best[:-step])
        span += step
    chosen = where[at]
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate([first, [len(at)]]))
    start = at[first]
    # The place of the anchor in the unit follows from its words; its length is in the hash.
    return start, n, grams[chosen[first]], runs.of(start, start + n + width - 1), runs


def _units(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets = W.flat(batch["text"])
            start, end, bounds = W.words(data, offsets, W.NOT_WHITE)
            at, n, anchor, unit, _ = _anchors(W.hashes(data, start, end), bounds, width, k)
            row = np.searchsorted(bounds, at, side="right") - 1
            doc = batch["doc"].to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, np.int64)
            part = batch["part"].to_numpy(zero_copy_only=False)[row] if len(row) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array((at - bounds[row]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(unit.view(np.int64))], [x.split()[0] for x in UNITS.split(", ")]
            )

    return run


WINDOWS = "doc long, part int, pos int, window_hash long"


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets = W.flat(batch["text"])
            start, end, bounds = W.words(data, offsets, W.NOT_WHITE)
            runs = W.Runs(W.hashes(data, start, end))
            units = batch["units"]
            row = np.repeat(np.arange(batch.num_rows), np.diff(units.offsets.to_numpy()))
            fields = units.flatten()
            at, n = fields.field("pos").to_numpy(zero_copy_only=False), fields.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
            pos = at.repeat(n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            row = row.repeat(n)
            begin = bounds[row] + pos
            doc, part = (batch[c].to_numpy(zero_copy_only=False)[row] for c in ("doc", "part"))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(part, pa.int32()), pa.array(pos.astype(np.int32)), pa.array(runs.of(begin, begin + width).view(np.int64))], [x.split()[0] for x in WINDOWS.split(", ")])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (its order), part (tells texts of the same doc_id apart), text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.hash("text").alias("part"), "text")


def repeats(docs: DataFrame, width: int = WIDTH, k: int = ANCHOR) -> DataFrame:
    """doc, part, pos, n: the windows starting at word pos ... pos + n - 1 each occur earlier as well."""
    keyed = _keyed(docs)
    units = keyed.select("doc", "part", "text").where(F.length("text") >= 2 * width - 1).mapInArrow(_units(width, k), UNITS)
    # Anchors that occur once have no partner: they go before anything is joined.
    # Written, so that the join deals both sides itself and can split an anchor that a large part of all rows has.
    often = written(units.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
    seeds = written(units.join(often, "anchor", "left_semi"), "seeds")
    place = F.struct("doc", "part", "pos")
    firsts = seeds.groupBy("unit").agg(F.min(F.struct("doc", "part", "pos", "n", "anchor")).alias("first"), F.count("*").alias("c"))
    firsts = written(firsts, "firsts")
    again = seeds.join(firsts.where("c > 1").select("unit", F.struct("first.doc", "first.part", "first.pos").alias("at")), "unit").where(place != F.col("at")).select("doc", "part", "pos", "n")
    open_anchors = written(firsts.groupBy(F.col("first.anchor").alias("anchor")).agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
    open_units = firsts.select("first.*").join(open_anchors, "anchor", "left_semi")
    by_doc = open_units.groupBy("doc", "part").agg(F.collect_list(F.struct("pos", "n")).alias("units"))  # one document's
    texts = keyed.select("doc", "part", "text")
    windows = written(texts.join(by_doc, ["doc", "part"]).mapInArrow(_windows(width), WINDOWS), "windows")
    # Written as well, so that the join can split a window that a large part of all rows has.
    least = written(windows.groupBy("window_hash").agg(F.min(place).alias("at"), F.count("*").alias("c")).where("c > 1").select("window_hash", "at"), "least")
    single = windows.join(least, "window_hash").where(place != F.col("at")).select("doc", "part", "pos", F.lit(1).alias("n"))
    return again.unionByName(single)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<begin:int,end:int>>"


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            data, offsets = W.flat(batch["text"])
            start, end, bounds = W.words(data, offsets, W.NOT_WHITE)
            total = int(bounds[-1])
            marks = np.zeros(total + 1, np.int64)
            hits = batch["hits"]
            row = np.repeat(np.arange(batch.num_rows), np.diff(hits.offsets.to_numpy()))
            fields = hits.flatten()
            at = bounds[row] + fields.field("pos").to_numpy(zero_copy_only=False)
            np.add.at(marks, at, 1)
            np.add.at(marks, at + fields.field("n").to_numpy(zero_copy_only=False) + width - 1, -1)
            gone = np.cumsum(marks[:-1]) > 0
            # Kept words joined by a space: copy their bytes and one separator each.
            keep = np.flatnonzero(~gone)
            length = end[keep] - start[keep] + 1
            sums = np.concatenate([[0], np.cumsum(length)])
            padded = np.concatenate([data, [0x20]]).astype(np.uint8)
            out = padded[np.arange(int(sums[-1])) + np.repeat(start[keep] - sums[:-1], length)]
            out[sums[1:] - 1] = 0x20
            raw = out.tobytes()
            per = np.searchsorted(keep, bounds)
            texts = [raw[sums[a] : max(sums[b] - 1, sums[a])] for a, b in zip(per[:-1].tolist(), per[1:].tolist(), strict=True)]
            edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
            inner = np.unique(np.concatenate([np.flatnonzero(edge), bounds[(bounds > 0) & (bounds < total) & gone[np.minimum(bounds, max(total - 1, 0))] & gone[bounds - 1]]])) if total else np.zeros(0, np.int64)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            cut = inner.tolist()
            for a, b in zip(cut, [*cut[1:], total][: len(cut)], strict=True):
                if a < total and gone[a]:
                    i = int(np.searchsorted(bounds, a, side="right")) - 1
                    spans[i].append({"begin": a - int(bounds[i]), "end": b - int(bounds[i])})
            removed = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.diff(bounds)), pa.array(np.diff(removed[bounds])), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), pa.array([x.decode() for x in texts], pa.string()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"],
            )

    return run


def dedup(docs: DataFrame, width: int = WIDTH, k: int = ANCHOR) -> DataFrame:
    """A row for each document: what is kept, its digest, and the removed runs of words."""
    hits = written(repeats(docs, width, k), "repeats").distinct().groupBy("doc", "part").agg(F.collect_list(F.struct("pos", "n")).alias("hits"))  # one document's
    none = F.expr("cast(array() as array<struct<pos:int,n:int>>)")
    return _keyed(docs).join(hits, ["doc", "part"], "left").select("doc_id", "text", F.coalesce("hits", none).alias("hits")).mapInArrow(_cut(width), RESULT)
