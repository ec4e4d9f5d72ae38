"""Shared plumbing: tables, scratch folders in shared storage, and Arrow batches cut by bytes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one step of an Arrow function handles at once; a longer text is a step of its own.
CHUNK_BYTES = 4 << 20
#: The same for functions that hold many numbers a word.
STEP_BYTES = 2 << 20

_made: list[tuple[SparkSession, str, str | None]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and there is one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tarnhelm-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tarnhelm-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path, None))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to shared storage and read again: lineage ends there, and lost executors take nothing with them."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def bucketed(df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
    """``df`` written to shared storage as a table in buckets by ``column``: what is grouped or joined by it is not shuffled again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table_name = path.rpartition("/")[2].replace("-", "_")
    _made.append((spark, path, table_name))
    df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(table_name)
    return spark.table(table_name)


def kept_as(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, which reads the written ``source``, with its folder: ``dropped`` then works on it."""
    df.scratch = source.scratch
    return df


def dropped(df: DataFrame) -> None:
    """Deletes what ``written`` has written for ``df``, once nothing that is yet to run reads it."""
    drop_path(df.sparkSession, df.scratch)


@atexit.register
def _clean() -> None:
    for spark, path, table_name in _made:
        try:
            if table_name:
                spark.sql(f"DROP TABLE IF EXISTS {table_name}")
            drop_path(spark, path)
        except Exception:  # the session may have ended before us
            pass


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``limit`` bytes in each; a longer value stands alone. Whole rows always."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, n in enumerate(lengths):
            if i > begin and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)
