"""Fact maintenance by Structured Streaming: each micro-batch is a commit, and readers see whole commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import latest_per_key


def commits(stream: DataFrame, folder: str, checkpoint: str, seq: str = "seq") -> StreamingQuery:
    """Writes each micro-batch to ``folder/commit=<batch id>``. A batch that is run again after a failure replaces its own folder, so a commit is there once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/commit={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark, folder: str, key: str, seq: str = "seq") -> DataFrame:
    """The last row of each key over all commits, with the commit that wrote it."""
    rows = spark.read.parquet(folder)
    order = F.struct("commit", seq)
    return latest_per_key(rows.withColumn("_order", order), key, "_order").drop("_order")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; a window closes once the watermark has passed it. An extension: the fact store itself has no event time."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
