"""Roll-ups of statuses to every ancestor, derived counts, catalog summaries and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The statuses that make up each count.
COUNTS = {
    "correct": "Correct CorrectMIA",
    "missing": "Missing DirCorrupt Corrupt CanBeFixed CanBeFixedMIA CorruptCanBeFixed MoveToCorrupt Incomplete",
    "missing_mia": "MissingMIA",
    "found_mia": "CorrectMIA",
    "fixes_needed": "CanBeFixed CanBeFixedMIA MoveToSort Delete NeededForFix Rename CorruptCanBeFixed MoveToCorrupt",
    "can_be_fixed": "CanBeFixed CanBeFixedMIA CorruptCanBeFixed",
    "fixable": "CanBeFixed CanBeFixedMIA CorruptCanBeFixed MoveToSort Delete MoveToCorrupt",
    "to_be_removed": "MoveToSort Delete MoveToCorrupt",
    "any_files": "Correct CorrectMIA UnNeeded Unknown InToSort Corrupt Ignore MoveToSort Delete NeededForFix Rename MoveToCorrupt",
    "not_collected": "NotCollected",
    "unknown": "Unknown",
    "in_to_sort": "InToSort",
}


def mia_relabel(status: Column, mia: Column) -> Column:
    """Statuses of files known to be missing in action."""
    return F.when(mia & status.isin("Missing", "CanBeFixed", "Correct"), F.concat(status, F.lit("MIA"))).otherwise(status)


def rollup(nodes: DataFrame) -> DataFrame:
    """nodes(path array, rep_status): (ancestor, depth, rep_status, n) over all ancestors, the node's own path included.
    The histogram by full path comes first, so what is expanded to ancestors does not grow with equal leaves."""
    leaf = nodes.groupBy("path", "rep_status").agg(F.count("*").alias("n"))
    each = leaf.select(F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth"), "path", "rep_status", "n")
    return each.groupBy(F.concat_ws("/", F.slice("path", F.lit(1), F.col("depth"))).alias("ancestor"), "depth", "rep_status").agg(F.sum("n").alias("n"))


def derived_counts(histogram: DataFrame, *by: str) -> DataFrame:
    """histogram(by..., rep_status, n): one column a count."""
    each = [F.sum(F.when(F.col("rep_status").isin(*names.split()), F.col("n")).otherwise(0)).alias(c) for c, names in COUNTS.items()]
    return histogram.groupBy(*by).agg(*each)


def catalog_class(counts: DataFrame) -> DataFrame:
    """Complete, completely missing, partial or fixing."""
    complete = (F.col("correct") > 0) & (F.col("missing") == 0) & (F.col("fixes_needed") == 0)
    absent = (F.col("correct") == 0) & (F.col("missing") > 0) & (F.col("fixes_needed") == 0)
    partial = ((F.col("correct") > 0) & (F.col("missing") > 0)) | (F.col("fixes_needed") > 0)
    return counts.withColumn("class", F.when(complete, "complete").when(absent, "missing").when(partial, "partial").otherwise("empty")).withColumn("fixing", F.col("fixes_needed") > 0)


def dir_class(counts: DataFrame) -> DataFrame:
    """The icon of a directory: staging, none, missing in action alone, complete or partial."""
    none = (F.col("correct") == 0) & (F.col("missing") == 0) & (F.col("missing_mia") == 0)
    return counts.withColumn(
        "dir_class",
        F.when(none & (F.col("in_to_sort") > 0), "staging").when((F.col("correct") == 0) & (F.col("missing") > 0), "none").when((F.col("missing") == 0) & (F.col("missing_mia") > 0), "mia").when((F.col("missing") == 0) & (F.col("correct") > 0), "complete").when(none, "empty").otherwise("partial"),
    )


def gap_catalog(nodes: DataFrame, include_fixable: bool = True) -> DataFrame:
    """What a catalog wants and nobody has; without fixable files if asked."""
    gap = (F.col("dat_status") == "InDatCollect") & (F.col("got_status") != "Got")
    return nodes.where(gap if include_fixable else gap & ~F.col("new_status").isin("CanBeFixed", "CorruptCanBeFixed"))


def game_filter(counts: DataFrame, text: str = "", *, complete: bool = True, partial: bool = True, empty: bool = True, fixes: bool = True, mia: bool = True, merged: bool = True) -> DataFrame:
    """Rows of derived_counts() with a `name` that a list shows: the name holds the text, whatever its case, and one of the
    asked kinds fits. What is unknown, in staging, corrupt (column `corrupt`, if there) or none of all kinds always shows."""
    has = {c: F.col(c) > 0 for c in ("correct", "missing", "unknown", "in_to_sort", "fixes_needed", "missing_mia")}
    all_merged = (F.col("not_collected") > 0) & (F.col("any_files") == 0)
    none = ~(has["correct"] | has["missing"] | has["unknown"] | has["in_to_sort"] | has["fixes_needed"] | has["missing_mia"] | all_merged)
    show = has["unknown"] | has["in_to_sort"] | none | (F.coalesce("corrupt", F.lit(False)) if "corrupt" in counts.columns else F.lit(False))
    kinds = [
        (complete, has["correct"] & ~has["missing"] & ~has["fixes_needed"]), (partial, has["missing"] & has["correct"]), (empty, has["missing"] & ~has["correct"]),
        (fixes, has["fixes_needed"]), (mia, has["missing_mia"]), (merged, all_merged),
    ]
    for asked, test in kinds:
        show = show | test if asked else show
    return counts.where(F.contains(F.lower("name"), F.lit(text.lower())) & show)
