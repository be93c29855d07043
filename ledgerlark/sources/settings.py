"""Rules, mappings and presets of a collection, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_of_key(rows: DataFrame, key: str = "dir_key", order: str = "ord") -> DataFrame:
    """Of rows that repeat a key, the first in order stays; equal places are settled by all columns."""
    whole = F.struct(order, F.struct(*rows.columns).alias("row"))
    return rows.groupBy(key).agg(F.min(whole).alias("first")).select("first.row.*")


def presets(rows: DataFrame) -> DataFrame:
    """rows(path, selected, expanded): marks of tree nodes; a path that is there more than once has no marks."""
    only = F.count("*") == 1
    return rows.groupBy("path").agg(F.when(only, F.first("selected")).alias("selected"), F.when(only, F.first("expanded")).alias("expanded"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of JSON lines, one row a directory; `ord` is the place in the list."""
    schema = "ord long, dir_key string, compression string, compression_sub string, merge string, filter string, header_type string, sub_dir_type string, compression_override boolean, merge_override boolean, single_archive boolean, use_description boolean, complete_only boolean, add_category boolean"
    return first_of_key(spark.read.schema(schema).json(path))


def catalogs_in_directory(files: DataFrame) -> DataFrame:
    """files(path) of catalogs with their directory, and whether it holds more than one."""
    of = files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("directory"))
    return of.join(of.groupBy("directory").agg((F.count("*") > 1).alias("multi")), "directory").select("path", "directory", "multi")
