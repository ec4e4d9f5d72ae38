"""Near-duplicate documents: ProbMinHash signatures, banding, and verification on the whole texts.

Shingles are five consecutive words (lower-cased, split at ASCII characters that are neither digit nor letter), hashed
to 64 bits; a text of fewer words, but not none, is one shingle. A shingle's weight is 1 + ln(its count). Each is a
Poisson process of its weight's rate, whose arrivals go to random components; a component keeps the shingle that
arrives first, so two texts agree in it with the probability Jaccard of their weights. Arrivals come in rounds over
all texts of a step; a shingle stops when its next arrival is later than all components of its text.

``BANDS`` bands of ``ROWS`` components are the buckets: texts of similarity 0.8 meet in one with probability
1 - (1 - 0.8 ** 4) ** 20 = 0.99998. Texts are compared once they are distinct: exact copies are one node, by digest; buckets
of the same texts are one bucket. All comparisons are of whole texts and exact: Jaccard or probability Jaccard of ``SIMILARITY``
or more. A class is a component of the links.

Two phases. First a bucket of up to ``PART`` texts is compared as a whole, in one task; a larger one is dealt into such parts,
each compared in itself and with the bucket's leaders (about ``LEADERS`` of its texts, who go to all parts), which makes one
component of n copies of a text in n comparisons or so. Then the components are found. A large bucket that still has more than one
is dealt into blocks, a large component into blocks of its own, and all pairs of blocks are compared but those of one component. So
each two texts of a bucket are compared or in one component at the end. A task gives the links that join its texts, not
the pairs it has compared; n texts that are alike but below the threshold still take n ** 2 / 2 comparisons, dealt out in blocks.

Defined cases: a null text is in no class but its own, whose id is its doc_id. Equal texts are one class, empty
ones too; an empty text is like no other. Null doc_ids join classes but aren't ids, unless no other is there.
An empty table gives an empty result. Extra columns are kept by ``drop_near_duplicates`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import STEP_BYTES, dropped, kept_as, pieces, written

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
#: Texts of a bucket that are compared in one task (rows, bytes), and of a block in the second phase; leaders of a large bucket.
PART, PART_BYTES, BLOCK, BLOCK_BYTES, LEADERS = 64, 4 << 20, 512, 8 << 20, 4
#: Cells of a matrix of texts by shingles that is held at once.
CELLS = 4 << 20


def shingles(column: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of each distinct shingle, by text, then hash."""
    data, offsets = W.flat(column)
    data = W.LOWER[data]
    start, end, bounds = W.words(data, offsets, W.ALNUM)
    runs = W.Runs(W.hashes(data, start, end))
    at = W.run_starts(bounds, k)
    n = np.diff(bounds)
    short = np.flatnonzero((n > 0) & (n < k))
    text = np.concatenate([np.searchsorted(bounds, at, side="right") - 1, short])
    h = np.concatenate([runs.of(at, at + k), runs.of(bounds[short], bounds[short + 1])])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(h)]]))
    return text[first], h[first], 1 + np.log(count)


def signatures(text: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """texts x m components, 32 bits of the shingle that arrives first; 0 where a text has none."""
    first = np.full(texts * m, np.inf)
    winner = np.zeros(texts * m, W.U)
    time, live, turn = np.zeros(len(h)), np.arange(len(h)), 0
    while len(live):
        random = W.mix(h[live] + W.U((2 * turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time[live] -= np.log(((random >> W.U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        slot = text[live] * m + ((W.mix(random ^ W.U(0x94D049BB133111EB)) >> W.U(32)) * W.U(m) >> W.U(32)).astype(np.int64)
        better = np.flatnonzero(time[live] < first[slot])
        slot, who = slot[better], live[better]
        np.minimum.at(first, slot, time[who])
        won = first[slot] == time[who]
        winner[slot[won]] = h[who[won]]
        owner = text[live]
        here = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        limit = np.repeat(first.reshape(texts, m)[owner[here]].max(axis=1), np.diff(np.concatenate([here, [len(owner)]])))
        live = live[time[live] < limit]
        turn += 1
    return winner.reshape(texts, m).astype(np.uint32)


SKETCH = "doc_id long, key binary, size int, bands array<long>"


def _sketch(bands: int, rows: int, k: int):
    """size: the text's bytes; bands: a hash of each band's components, empty for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", STEP_BYTES):
            text, h, weight = shingles(batch["text"], k)
            n = batch.num_rows
            made = signatures(text, h, weight, n, bands * rows)
            has = np.zeros(n, bool)
            has[text] = True
            value = np.zeros((n, bands), W.U)
            for j in range(rows):
                value = W.mix(value ^ made[:, j::rows].astype(W.U))
            offsets = np.concatenate([[0], np.cumsum(np.where(has, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[has].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pc.binary_length(batch["text"]).cast(pa.int32()), lists], ["doc_id", "key", "size", "bands"])

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of Jaccard and probability Jaccard of two sets of (sorted hashes, weights)."""
    (ha, wa), (hb, wb) = a, b
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    union = len(ha) + len(hb) - len(common)
    if not len(common):
        return 0.0
    x, y = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(-(x / y), kind="stable")
    x, y = x[order], y[order]
    # Common shingles by falling x / y: those before d, and of a alone, count by x; those after, and of b alone, by y.
    above = only_a + np.cumsum(x)
    below = only_b + y.sum() - np.cumsum(y)
    return max(len(common) / union, float((1 / (above / x + below / y)).sum()))


class Sets:
    """The shingle sets of some texts: set i has hashes[at[i]:at[i + 1]], sorted, with their weights."""

    def __init__(self, at: np.ndarray, hashes: np.ndarray, weights: np.ndarray):
        self.at, self.hashes, self.weights = at, hashes, weights

    @classmethod
    def of(cls, column: pa.Array, k: int) -> Sets:
        text, h, weight = shingles(column, k)
        return cls(np.searchsorted(text, np.arange(len(column) + 1)), h, weight)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at[i], self.at[i + 1]
        return self.hashes[a:b], self.weights[a:b]

    def between(self, a: int, b: int) -> Sets:
        return Sets(self.at[a : b + 1] - self.at[a], self.hashes[self.at[a] : self.at[b]], self.weights[self.at[a] : self.at[b]])

    def close(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Two square matrices: pairs whose Jaccard is ``threshold`` or more; other pairs whose probability Jaccard may be.

        All pairs at once, as products of the matrix of texts by shared shingles. With x, y the weights of a common shingle, A and B what
        is in one text alone, no term of the probability Jaccard is over max(x, y) / (A + B + max(sum x, sum y)), and max(x, y) <= x + y - 1.
        """
        n, size = len(self.at) - 1, np.diff(self.at)
        row = np.repeat(np.arange(n), size)
        order = np.argsort(self.hashes, kind="stable")
        sorted_ = self.hashes[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        group = np.cumsum(new) - 1
        again = np.bincount(group)[group] > 1  # a shingle of one text alone is in no product
        column = (np.cumsum(new & again) - 1)[again]
        row, weight = row[order][again], self.weights[order][again].astype(np.float32)
        common, held = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
        plain = bool((self.weights == 1).all())
        columns, width = int(column[-1]) + 1 if len(column) else 0, max(1, CELLS // n)
        for a in range(0, columns, width):
            part = slice(*np.searchsorted(column, [a, a + width]))
            ones = np.zeros((n, min(width, columns - a)), np.float32)
            ones[row[part], column[part] - a] = 1
            common += ones @ ones.T
            if not plain:
                heavy = np.zeros_like(ones)
                heavy[row[part], column[part] - a] = weight[part]
                held += heavy @ ones.T
        common = common.astype(np.float64)
        both = size[:, None] + size[None, :]
        good = common >= threshold * (both - common) - 1e-9
        if plain:
            return good, np.zeros((n, n), bool)
        held = held.astype(np.float64)
        weights = np.concatenate([[0.0], np.cumsum(self.weights)])
        total = np.diff(weights[self.at])
        alone = total[:, None] + total[None, :] - held - held.T
        return good, ~good & (held + held.T - common >= (threshold - 1e-4) * (alone + np.maximum(held, held.T)))


def merged(good: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels, as few as the links of ``good`` make of ``labels``."""
    labels = labels.copy()
    for i in range(len(labels)):
        near = labels[good[i]]
        if (near != labels[i]).any():
            labels[np.isin(labels, near)] = labels[i]
    return labels


def forest(sets: Sets, labels: np.ndarray, threshold: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between texts of different labels, no more than join all that are linked. side: only links from one side to the other."""
    good, maybe = sets.close(threshold)
    if side is not None:
        across = side[:, None] != side[None, :]
        labels = merged(good & ~across, labels)
        good, maybe = good & across, maybe & across
    out, labels = [], labels.copy()
    for i in range(len(labels)):
        for j in np.flatnonzero(good[i] & (labels != labels[i])).tolist():
            if labels[j] != labels[i]:
                out.append((i, j))
                labels[labels == labels[j]] = labels[i]
    for i, j in zip(*np.nonzero(np.triu(maybe & (labels[:, None] != labels[None, :]))), strict=True):
        if labels[i] != labels[j] and similarity(sets[i], sets[j]) >= threshold:
            out.append((int(i), int(j)))
            labels[labels == labels[j]] = labels[i]
    return out


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], limit: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in order of the columns ``names``, as tables of whole groups with about ``limit`` bytes of text, and where each group starts."""

    def cut(rows: pa.Table, all_: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        new = np.zeros(rows.num_rows, bool)
        new[:1] = True
        for c in names:
            x = rows[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        start = np.append(np.flatnonzero(new), rows.num_rows)
        size = np.concatenate([[0], np.cumsum(pc.binary_length(rows["text"]).to_numpy())])[start]
        a, last = 0, len(start) - 1 if all_ else len(start) - 2
        while a < last:
            b = min(last, max(a + 1, int(np.searchsorted(size, size[a] + limit, side="right")) - 1))
            yield rows.slice(start[a], start[b] - start[a]), start[a : b + 1] - start[a]
            a = b
        return rows.slice(start[last])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            rest = yield from cut(pa.Table.from_batches(held), False)
            held, size = rest.combine_chunks().to_batches(), 0
    if held:
        yield from cut(pa.Table.from_batches(held), True)


def _compare(names: list[str], threshold: float, k: int):
    """Rows in groups by ``names`` with key, text, and in the second phase label and two parts. Gives links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, start in _groups(batches, names, STEP_BYTES):
            sets = Sets.of(rows["text"].combine_chunks(), k)
            labelled = "label" in rows.column_names
            if labelled:
                label = np.unique(rows["label"].to_numpy(), return_inverse=True)[1]
                part, one, two = (rows[c].to_numpy() for c in ("part", "one", "two"))
            a, b = [], []
            for x, y in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
                labels, side = np.arange(y - x), None
                if labelled:
                    labels = label[x:y]
                    side = part[x:y] if one[x] != two[x] else None
                if y - x == 2 and not labelled:
                    found = [(0, 1)] if similarity(sets[x], sets[x + 1]) >= threshold else []
                else:
                    found = forest(sets.between(x, y), labels, threshold, side)
                a += [x + i for i, _ in found]
                b += [x + j for _, j in found]
            keys = rows["key"].combine_chunks()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(a, pa.int64())), keys.take(pa.array(b, pa.int64()))], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of the nodes of ``links`` (a, b): least label of the neighbours, then the label's label, until nothing changes."""
    both = written(links.union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        new = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "least").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = written(new.join(up, "component").select("node", "was", F.least("component", "root").alias("component")), "labels")
        changed = new.where("was != component").limit(1).count()
        dropped(labels)
        labels = kept_as(new.select("node", "component"), new)
        if not changed:
            dropped(both)
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``labels`` after ``links`` are added. Only the links between components are walked."""
    known = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    ends = links.join(known("a"), "a", "left").join(known("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    over = components(ends).toDF("component", "_to")
    nodes = labels.unionByName(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left_anti").withColumn("component", F.col("node")))
    return written(nodes.join(over, "component", "left").select("node", F.coalesce("_to", "component").alias("component")), "labels")


def _parts(rows: str, size: str, most: int, most_bytes: int) -> Column:
    return F.ceil(F.greatest(F.col(rows) / most, F.col(size) / most_bytes)).cast("int")


def _compared(rows: DataFrame, texts: DataFrame, names: list[str], threshold: float, k: int) -> DataFrame:
    """Links of the groups by ``names`` of rows (key, ...), whose texts are in ``texts``."""
    full = rows.join(texts, "key").repartition(*names).sortWithinPartitions(*names)
    return written(full.mapInArrow(_compare(names, threshold, k), "a binary, b binary"), "close")


def _first_phase(members: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame:
    """Buckets that are one part are compared as a whole; a part of a larger one in itself and with the bucket's leaders."""
    order = F.pmod(F.xxhash64("key", "bucket"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    placed = members.withColumn("parts", _parts("n", "total", PART, PART_BYTES)).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    leads = placed.where((F.col("parts") > 1) & ((order * F.col("n") < LEADERS) | (F.col("key") == F.col("least"))))
    every = leads.select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to"), "key", "part").where("to != part")
    rows = placed.select("bucket", "part", "key").union(every.select("bucket", "to", "key"))
    return _compared(rows, texts, ["bucket", "part"], threshold, k)


def _second_phase(members: DataFrame, labels: DataFrame, texts: DataFrame, threshold: float, k: int) -> DataFrame | None:
    """Large buckets that are of more than one component yet: all pairs of parts but those of one component. None if there is no such bucket."""
    large = members.where(_parts("n", "total", PART, PART_BYTES) > 1)
    placed = large.join(labels.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", "size", F.coalesce("component", "key").alias("component"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low != _high").select("bucket")
    placed = written(placed.join(open_, "bucket", "left_semi"), "open")
    if not placed.limit(1).count():
        return None
    # A component that fills a part is in parts of its own; the others are dealt into parts together.
    whole = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("total")).withColumn("parts", _parts("n", "total", BLOCK, BLOCK_BYTES))
    small = whole.where("parts = 1").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select("bucket", _parts("n", "total", BLOCK, BLOCK_BYTES).alias("small_parts"))
    where = whole.join(small, "bucket", "left").select("bucket", "component", "parts", "small_parts")
    part = F.when(F.col("parts") > 1, F.xxhash64("component", F.pmod(F.xxhash64("key"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("component"), F.col("small_parts")))
    dealt = placed.join(where, ["bucket", "component"]).select("bucket", "key", F.col("component").alias("label"), part.alias("part"), F.when(F.col("parts") > 1, F.col("component")).alias("own"))
    dealt = written(dealt, "dealt")
    parts = written(dealt.groupBy("bucket", "part").agg(F.max("own").alias("own")), "parts")
    one, two = (parts.toDF("bucket", x, f"own_{x}") for x in ("one", "two"))
    pairs = one.join(two, "bucket").where("one <= two and not coalesce(own_one = own_two, false)").select("bucket", "one", "two")
    ends = pairs.select("bucket", F.explode(F.array_distinct(F.array("one", "two"))).alias("part"), "one", "two")
    rows = dealt.drop("own").join(ends, ["bucket", "part"])
    return _compared(rows, texts, ["bucket", "one", "two"], threshold, k)


def _linked(docs: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame | None:
    """node, component of the linked texts."""
    buckets = nodes.select("key", "size", F.posexplode("bands").alias("band", "value")).select("key", "size", F.xxhash64("band", "value").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    met = written(buckets.join(shared, "bucket", "left_semi"), "met")
    # Buckets of the same texts, as those of a pair that meets in several bands, are one.
    same = [F.bit_xor(F.xxhash64(F.lit(i), "key")).alias(f"x{i}") for i in (0, 1)]
    facts = met.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("key").alias("least"), *same)
    kept = facts.groupBy("n", "x0", "x1").agg(F.min(F.struct("bucket", "total", "least")).alias("b")).select("b.bucket", "n", "b.total", "b.least")
    members = written(met.join(kept, "bucket"), "members")
    dropped(met)
    wanted = nodes.select("key", "least").join(members.select("key").distinct(), "key", "left_semi")
    rows = docs.join(wanted, "key").where(F.col("doc_id").eqNullSafe(F.col("least"))).select("key", "text")
    texts = written(rows.groupBy("key").agg(F.first("text").alias("text")), "texts")  # the texts that met another, once each
    links = _first_phase(members, texts, threshold, k)
    labels = components(links)
    more = _second_phase(members, labels, texts, threshold, k)
    if more is not None and more.limit(1).count():
        labels = joined(labels, more)
    for x in (members, texts):
        dropped(x)
    return labels


def _classes(docs: DataFrame, k: int = WORDS, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``classes`` with component: the least doc_key of the class, null for a null text. Unlike class_id, it is one class's alone."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("key"), "text")
    some = keyed.where("text is not null")
    sketched = some.mapInArrow(_sketch(bands, rows, k), SKETCH)
    nodes = written(sketched.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    labels = _linked(some, nodes, threshold, k)
    placed = nodes.select("key", "least", "copies").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    facts = placed.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    grouped = placed.select("key", "component").join(facts, "component").select("key", "component", "class_id", "class_size")
    out = keyed.select("doc_id", "key").join(grouped, "key", "left")
    return out.select("doc_id", F.col("key").alias("doc_key"), "component", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, doc_key (digest of the text), class_id (the least doc_id of the class), class_size."""
    return _classes(docs, **options).drop("component")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, that of the least doc_id, then doc_key; of its repeated rows, one. All columns stay. Null texts stay."""
    found = _classes(docs.select("doc_id", "text"), **options).where("doc_key is not null")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_key"))
    keep = found.groupBy("component").agg(best.alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.doc_key").alias("_key"))
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc_id"), F.unhex(F.md5("text")).alias("_doc_key"))
    kept = packed.join(keep, packed["_doc_key"].eqNullSafe(keep["_key"]) & packed["_doc_id"].eqNullSafe(keep["_id"]), "left_semi")
    if docs.groupBy(F.col("doc_id")).count().where("count > 1").limit(1).count():
        kept = kept.groupBy("_doc_id", "_doc_key").agg(F.first("_row").alias("_row"))
    return kept.select("_row.*").unionByName(docs.where("text is null"))
