"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table that one task groups.
TASK_ROWS = 1_200_000

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where it is unset and there is one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tarnhelm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnhelm-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as its rows need. Adaptive plans cut by compressed bytes, of which narrow rows have few, and a task's memory goes by rows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)), *keys)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # the session may have ended before us
            pass
