"""Intermediate tables in the shared folder: computed once, read by every later step, there still when executors go."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def _base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own if everything runs in one process."""
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="ledgerlark-"))
    return f"file://{_own[0]}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table, read back with its schema; deleted when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{_base(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)
