"""Mixing sources to target weights, all in DataFrame operations.

Every document gets a hash-random key. Within a source, documents are range-sorted by key: the top of the key deals them
into buckets, which are ranges of keys of like size however large the source is, and each bucket is sorted. Prefix sums
of sizes are the sum of the buckets before (one row a bucket) and the running sum within the bucket. A source takes
whole epochs while they fit its budget, then the documents whose prefix sums start below what is left, the last one
in part.

Budgets: sources by code point (null last) weigh ``weights`` in turn and share ``total`` words. A budget stops at
``cap`` times its source's size; the excess is shared again by weight until none is above.

Defined cases: a null or empty text has size 0 and takes 0. A null source is a source, ordered last. Equal
rows are interchangeable; rows with the same doc_id are ordered by a hash of their text. An empty table, or
one without words, takes nothing. Extra columns are kept by ``mix`` and not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS, CAP = (1.0, 2.0, 3.0), 3.0
#: Documents that a bucket has about.
BUCKET_ROWS = 2_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """source, source_size, target from source, source_size. One row a source; each round is one aggregation, and only its two sums come back."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    open_ = written(sizes.withColumn("weight", turn).withColumn("target", F.lit(None).cast("double")), "sources")
    total = (open_.agg(F.sum("source_size")).first()[0] or 0) * share
    left, last = float(total), None
    while True:
        weight = open_.where("target is null").agg(F.sum("weight")).first()[0]
        if not weight:
            break
        level = left / weight
        capped = F.col("target").isNull() & (F.col("weight") * level > cap * F.col("source_size"))
        taken = open_.where(capped).agg(F.sum("source_size"), F.count("*")).first()
        if not taken[1]:
            last = level
            break
        left -= cap * taken[0]
        open_ = open_.withColumn("target", F.when(capped, cap * F.col("source_size")).otherwise(F.col("target")))
    return open_.select("source", "source_size", F.coalesce("target", F.col("weight") * F.lit(last or 0.0)).alias("target"))


def _placed(docs: DataFrame, carry: Column, weights, cap: float, share: float, seed: int, once: bool) -> DataFrame:
    """_row (``carry``), size, target, source_size, before (words of the source before this document). once: words are counted once and written, which is worth it for rows without texts."""
    id_ = F.col("doc_id").cast("long")
    rows = docs.select(carry.alias("_row"), id_.alias("id"), F.col("source"), word_count("text").alias("size"), F.xxhash64(F.lit(seed), id_).alias("key"), F.xxhash64("text").alias("tie"))
    rows = written(rows, "sizes") if once else rows
    counted = docs.count()
    buckets = max(1, math.ceil(counted / BUCKET_ROWS))
    # The key's upper 32 bits as a number from 0, times buckets, divided by 2 ** 32: ranges of the key, in its order.
    bucket = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 32) * F.lit(buckets)
    rows = rows.withColumn("bucket", F.shiftrightunsigned(bucket, 32))
    rows = rows.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))  # null as a key
    sums = written(rows.groupBy("src", "source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    goals = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap, share)
    goals = goals.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    earlier = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    facts = sums.select("src", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset")).join(goals, "src")
    within = Window.partitionBy("src", "bucket").orderBy("key", "id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_bucket", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(facts, ["src", "bucket"])
    return joined.select("_row", "size", "source_size", "target", (F.col("offset") + F.col("in_bucket")).alias("before"))


def _budgets(placed: DataFrame) -> DataFrame:
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    epochs = F.when(epochs * F.col("source_size") > budget, epochs - 1).otherwise(epochs).cast("long")
    placed = placed.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("before")))
    return placed.withColumn("part", part)


def allot(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, share: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), epochs (whole ones), part (words of the last epoch)."""
    got = _budgets(_placed(docs, F.struct("doc_id"), weights, cap, share, seed, True))  # no text is shuffled
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return got.select(F.col("_row.doc_id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), "epochs", "part")


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, share: float = 1.0, seed: int = 0) -> DataFrame:
    """The mixture itself: rows of ``docs``, all columns, once for each whole epoch and once more if the cut leaves at least half of the document's words.

    Documents are whole, so a source is off its budget by half a document at most. A document without words comes as
    often as its source has whole epochs.
    """
    got = _budgets(_placed(docs, F.struct("*"), weights, cap, share, seed, False))
    times = F.col("epochs") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    return got.withColumn("times", times.cast("int")).where("times > 0").select("_row", F.explode(F.sequence(F.lit(1), "times"))).select("_row.*")
