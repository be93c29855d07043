"""Incremental refresh as a stream: new files are hashed once, each micro-batch is merged by path and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.sources.inventory import hashes

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (path, mtime, hashes) for files that appear below path."""
    files = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), *hashes(F.col("content")))


def refresh(stream: DataFrame, table: str, checkpoint: str):
    """Write each micro-batch's rows that the table lacks, as a folder of its own named by the stream and the batch, so a
    batch that is repeated replaces what it wrote before. Of the table only paths and times are read, and only rows whose
    time lies in the batch's range."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        new = batch.dropDuplicates(["path", "mtime"])
        first, last = batch.agg(F.min("mtime"), F.max("mtime")).first()
        if first is None:
            return
        try:
            known = spark.read.parquet(table).where((F.col("batch") != own) & F.col("mtime").between(first, last)).select("path", "mtime")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            new = new.join(known, ["path", "mtime"], "left_anti")
        new.write.mode("overwrite").parquet(f"{table}/batch={own}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
