"""Attributes of nodes: where they come from, how they are merged, and what views and exports show of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("size", "crc", "sha1", "md5")
# The hashes of no bytes.
EMPTY = {"crc": "00000000", "md5": "d41d8cd98f00b204e9800998ecf8427e", "sha1": "da39a3ee5e6b4b0d3255bfef95601890afd80709"}


def zero_length(name: str = "name", size: str = "size") -> Column:
    """All that is known of size and hashes is that of no bytes; if nothing is known, the name is a directory's."""
    known = [F.coalesce(F.col(h) == v, F.lit(True)) for h, v in EMPTY.items()] + [F.coalesce(F.col(size) == 0, F.lit(True))]
    fits = known[0] & known[1] & known[2] & known[3]
    any_known = F.coalesce(*(F.col(h) for h in EMPTY), F.col(size).cast("string")).isNotNull()
    return F.when(any_known, fits).otherwise(F.coalesce(F.col(name).endswith("/") & (F.length(name) > 1), F.lit(False)))


def deep_scanned(nodes: DataFrame) -> DataFrame:
    """nodes(archive, got_status, *_verified, header_from_file, alt_*_verified) to (archive, deep): every member there is
    has all its attributes verified, those behind a header too."""
    own = F.lit(True)
    for f in FIELDS:
        own = own & F.coalesce(f"{f}_verified", F.lit(False)) & (~F.coalesce("header_from_file", F.lit(False)) | F.coalesce(f"alt_{f}_verified", F.lit(False)))
    return nodes.where("got_status = 'Got'").groupBy("archive").agg(F.bool_and(own).alias("deep"))


def merge_found(pairs: DataFrame) -> DataFrame:
    """pairs(state struct, scan struct, by_alt): what is known stays, what the scan adds comes in. When the scan matched
    behind a header, the known attributes move to the alternates first."""
    out = {}
    for f in FIELDS:
        old, new, alt, alt_new = (F.col(c) for c in (f"state.{f}", f"scan.{f}", f"state.alt_{f}", f"scan.alt_{f}"))
        out[f] = F.when(F.col("by_alt"), new).otherwise(F.coalesce(old, new))
        out[f"alt_{f}"] = F.when(F.col("by_alt"), F.coalesce(alt, old, alt_new)).otherwise(F.coalesce(alt, alt_new))
    return pairs.withColumns(out).drop("state", "scan", "by_alt")


def attach(nodes: DataFrame) -> DataFrame:
    """nodes(size, ..., dat_size, ...): a catalog entry's attributes fill gaps, and flags tell which ones it gave."""
    filled = {f: F.coalesce(f, f"dat_{f}") for f in FIELDS}
    return nodes.withColumns(filled | {f"{f}_from_dat": F.col(f"dat_{f}").isNotNull() for f in FIELDS}).drop(*(f"dat_{f}" for f in FIELDS))


def detach(nodes: DataFrame) -> DataFrame:
    """Without its catalog a node keeps what its file verifies; what nothing but the catalog said goes."""
    kept = {f: F.when(F.col(f"{f}_verified") | ~F.col(f"{f}_from_dat"), F.col(f)) for f in FIELDS}
    return nodes.withColumns(kept | {f"{f}_from_dat": F.lit(False) for f in FIELDS} | {"dat_status": F.lit("NotInDat")})


def absorb_alternates(groups: DataFrame, headered: DataFrame) -> DataFrame:
    """headered(group_id, node_id, size, crc, sha1, md5): missing entries with headers that joined a group; their hashes
    become the group's alternates where it has none, the least node_id's first."""
    first = headered.groupBy("group_id").agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.col("node_id"))).alias(f"new_{f}") for f in FIELDS))
    joined = groups.join(first, "group_id", "left")
    return joined.withColumns({f"alt_{f}": F.coalesce(f"alt_{f}", f"new_{f}") for f in FIELDS}).drop(*(f"new_{f}" for f in FIELDS))


def archive_sizes(nodes: DataFrame, *by: str) -> DataFrame:
    """Bytes of what archives will hold, and of what leaves them for staging."""
    to_staging, wanted = F.col("new_status") == "MoveToSort", F.col("new_status").isin("Correct", "CanBeFixed", "CorruptCanBeFixed", "InToSort")
    return nodes.groupBy(*by).agg(F.coalesce(F.sum(F.when(wanted, F.col("size"))), F.lit(0)).alias("wanted_bytes"), F.coalesce(F.sum(F.when(to_staging, F.col("size"))), F.lit(0)).alias("staging_bytes"))


def selected(nodes: DataFrame, selection: str = "selection") -> DataFrame:
    """Nodes whose nearest mark isn't UnSelected (marks are inherited by state.inherit)."""
    return nodes.where(F.coalesce(selection, F.lit("Selected")) != "UnSelected")


def fixes_total(nodes: DataFrame) -> DataFrame:
    """One row: how many nodes of the selected subtrees can be fixed."""
    return selected(nodes).agg(F.count_if(F.col("new_status").isin("CanBeFixed", "CanBeFixedMIA", "CorruptCanBeFixed")).alias("n_fixes"))


def export_class(status: Column) -> Column:
    """got, missing, fixable or merged; null for what no export takes."""
    return (
        F.when(status.isin("Correct", "CorrectMIA"), "got")
        .when(status.isin("CanBeFixed", "CanBeFixedMIA", "CorruptCanBeFixed"), "fixable")
        .when(status.isin("Missing", "MissingMIA", "Corrupt", "Incomplete"), "missing")
        .when(status.isin("NotCollected", "UnNeeded"), "merged")
    )


def sourced(value: Column, from_dat: Column, from_header: Column, verified: Column) -> Column:
    """A value with letters for where it comes from: D catalog, F header of the file, V verified."""
    letters = F.concat(*(F.when(F.coalesce(c, F.lit(False)), letter).otherwise("") for c, letter in ((from_dat, "D"), (from_header, "F"), (verified, "V"))))
    return F.when(value.isNotNull(), F.when(letters == "", value.cast("string")).otherwise(F.concat(value.cast("string"), F.lit(" ("), letters, F.lit(")"))))


def shown_columns(rows: DataFrame) -> DataFrame:
    """One row: for each column whether any row has a value in it."""
    return rows.agg(*(F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(c) for c in rows.columns))


def file_grid(nodes: DataFrame) -> DataFrame:
    """The columns of a file list: name with what was found and the header's kind, merge name, primary and alternate
    attributes with the letters of their sources, status, date, place in the archive, copies. nodes: name, found_name,
    disk_version, header_type, header_required, merge, status, date, place, n_files, and for each attribute its value,
    *_from_dat, *_from_file and *_verified."""
    of = lambda c: F.coalesce(c, F.lit(False))
    letters = F.concat(F.when(of("header_type_from_dat"), "D").otherwise(""), F.when(of("header_from_file"), "F").otherwise(""))
    head = F.when(F.col("header_type").isNotNull() | (letters != ""), F.concat(F.lit(" ("), F.coalesce("header_type", F.lit("Nothing")), F.when(of("header_required"), ",Required").otherwise(""), F.lit(" "), letters, F.lit(")"))).otherwise("")
    shown = F.concat(F.col("name"), F.when(F.coalesce("found_name", F.lit("")) != "", F.concat(F.lit(" (Found: "), "found_name", F.lit(")"))).otherwise(""), F.when(F.col("disk_version").isNotNull(), F.concat(F.lit(" (V"), F.col("disk_version").cast("string"), F.lit(")"))).otherwise(""), head)
    cells = [sourced(F.format_number(F.col(f), 0) if f.endswith("size") else F.col(f), F.col(f"{f}_from_dat"), F.col(f"{f}_from_file"), F.col(f"{f}_verified")).alias(f) for f in (*FIELDS, *(f"alt_{f}" for f in FIELDS))]
    place = F.when((F.col("file_type") == "FileZip") & (F.col("place") >= 0), F.col("place").cast("string"))
    return nodes.select("node_id", shown.alias("rom"), "merge", *cells, "status", F.date_format("date", "yyyy/MM/dd HH:mm:ss").alias("date"), place.alias("place"), F.col("n_files").cast("string").alias("copies"))
