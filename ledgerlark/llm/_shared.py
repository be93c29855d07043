"""What the operators share: Arrow access, scratch tables in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own_base: list[str] = []


def scratch_base(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own if everything runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_base:
        _own_base.append(tempfile.mkdtemp(prefix="ledgerlark-"))
    return f"file://{_own_base[0]}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: it cuts the lineage, is computed once,
    and survives lost executors. The table goes when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{scratch_base(spark)}/ledgerlark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_quietly_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of materialise() that nothing reads any more."""
    if path := getattr(df, "_scratch_path", None):
        _delete(df.sparkSession, path)


def _quietly_delete(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session may have ended before the interpreter does
        pass


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished jobs now; it acts when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Empties what an operator's tasks keep in a Python worker for the next ones, by operator.
KEPT: dict[str, Callable[[], None]] = {}


def hand_back() -> None:
    """Freed memory goes back to the system; allocators keep it otherwise, and Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable) -> Callable:
    """run, a function of a task's batches, without what tasks of other operators left in the worker.
    Memory that it frees goes back to the system at its end."""

    def task(batches):
        for empty in list(KEPT.values()):
            empty()
        hand_back()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return task


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, row by row."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()
