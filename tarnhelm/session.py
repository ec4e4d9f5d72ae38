"""A session with the settings that the engine expects; every value can be overridden."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName("tarnhelm").config(map=SETTINGS | extra)
    return (builder.master(master) if master else builder).getOrCreate()
