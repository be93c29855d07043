"""The corpus pipeline: quality, near-duplicates, repeated passages, packing.

run(spark, sf_dir) applies STAGES to documents; each stage works on all that the one before it kept, from a written
table. Rows with null doc_id or text pass through the stages as their operators define it; other columns are kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import packing, quality, simhash, substrings
from ledgerlark.llm._shared import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is at least one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.selected(docs, quality.train(docs, quality.graded(labels)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id."""
    gone = materialise(simhash.near_duplicates(docs).select("doc_id")).hint("merge")  # one plan at every size
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that an earlier one has too."""
    return substrings.cut_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("substrings", substring_stage), ("packing", packing_stage)]

#: A classifier's training, SimHash groups and best fit have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
