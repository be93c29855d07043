"""The status engine: allowed statuses, defaults, validated assignment and the classification of content groups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import agrees
from ledgerlark.operators import matching
from ledgerlark.sources.scratch import written

# Allowed statuses by (kind of node, dat status), for not got / got / corrupt / locked; the first is the default.
_DIR = {
    "InDatCollect": ("DirMissing", "DirCorrect", "", ""),
    "InToSort": ("Deleted", "DirInToSort", "", ""),
    "NotInDat": ("Deleted", "DirUnknown", "", ""),
}
_ARCHIVE = {
    "InDatCollect": ("DirMissing", "DirCorrect", "DirCorrupt", "UnScanned"),
    "InToSort": ("Deleted", "DirInToSort", "DirCorrupt", "UnScanned"),
    "NotInDat": ("Deleted", "DirUnknown", "DirCorrupt", "UnScanned"),
}
_FILE = {
    "InDatCollect": ("Missing CanBeFixed Incomplete", "Correct IncompleteRemove MoveToSort NeededForFix Delete", "Corrupt MoveToCorrupt CorruptCanBeFixed", "UnScanned"),
    "InDatMerged": ("NotCollected", "UnNeeded Delete MoveToSort NeededForFix", "Corrupt MoveToCorrupt Delete", "UnScanned"),
    "InToSort": ("Deleted", "InToSort Ignore NeededForFix Delete", "Corrupt Delete", "UnScanned"),
    "NotInDat": ("Deleted", "Unknown Ignore Delete MoveToSort NeededForFix Rename", "Corrupt MoveToCorrupt Delete", "UnScanned"),
}
_MEMBER = {
    "InDatCollect": _FILE["InDatCollect"],
    "InDatMerged": ("NotCollected", "UnNeeded Delete MoveToSort NeededForFix Rename", "Corrupt MoveToCorrupt Delete", "UnScanned"),
    "InToSort": ("Deleted", "InToSort NeededForFix Delete", "Corrupt Delete", "UnScanned"),
    "NotInDat": ("Deleted", "Unknown Delete MoveToSort NeededForFix Rename", "Corrupt MoveToCorrupt Delete", "UnScanned"),
}
_KINDS = {"Dir": _DIR, "Zip": _ARCHIVE, "SevenZip": _ARCHIVE, "File": _FILE, "FileZip": _MEMBER, "FileSevenZip": _MEMBER}
GOT = ("NotGot", "Got", "Corrupt", "FileLocked")

CUBE = {(kind, dat, got): tuple(names.split()) for kind, rows in _KINDS.items() for dat, cells in rows.items() for got, names in zip(GOT, cells, strict=True) if names}


def allowed(file_type: Column, dat_status: Column, got_status: Column) -> Column:
    """Allowed statuses as an array; null where the combination has none. A map literal: no join is needed."""
    entries = chain.from_iterable((F.lit("|".join(k)), F.array(*map(F.lit, v))) for k, v in CUBE.items())
    return F.try_element_at(F.create_map(*entries), F.concat_ws("|", file_type, dat_status, got_status))


def with_default(nodes: DataFrame, ignore: str | None = None) -> DataFrame:
    """nodes with `allowed` and `rep_status`: the default, Error where nothing is allowed, Ignore for plain files found
    outside catalogs whose name matches `ignore`."""
    out = nodes.withColumn("allowed", allowed(F.col("file_type"), F.col("dat_status"), F.col("got_status")))
    status = F.coalesce(F.get("allowed", F.lit(0)), F.lit("Error"))
    if ignore:
        hit = (F.col("got_status") == "Got") & (F.col("dat_status") == "NotInDat") & (F.col("file_type") == "File") & F.col("name").rlike(ignore)
        status = F.when(hit, F.lit("Ignore")).otherwise(status)
    return out.withColumn("rep_status", status)


def validated(status: Column, among: Column) -> Column:
    """status where it is allowed, else Error."""
    return F.when(F.array_contains(among, status), status).otherwise(F.lit("Error"))


def fixes(missing, got) -> Column:
    """May the found row fix the missing one (within a content group)? Known kinds of header must be equal, and a required
    one must have been found in the file itself. A verified primary mismatch counts only if the header-stripped hash is
    verified and mismatches as well. Rows are functions from a field's name to its column."""
    def clash(kind: str) -> Column:
        want = missing(kind)
        return got(f"{kind}_verified") & ~agrees(want, got(kind)) & got(f"alt_{kind}_verified") & ~agrees(want, got(f"alt_{kind}"))

    headless = missing("header_required") & (got("header_type").isNull() | ~F.coalesce(got("header_from_file"), F.lit(False)))
    return agrees(missing("header_type"), got("header_type")) & ~F.coalesce(headless, F.lit(False)) & ~F.coalesce(clash("sha1"), F.lit(False)) & ~F.coalesce(clash("md5"), F.lit(False))


def duplicates(a, b) -> Column:
    """Two found rows of a group are the same content unless both hashes are verified and differ."""
    def clash(kind: str) -> Column:
        return a(f"{kind}_verified") & b(f"{kind}_verified") & ~agrees(a(kind), b(kind))

    return ~F.coalesce(clash("sha1"), F.lit(False)) & ~F.coalesce(clash("md5"), F.lit(False))


FIX_KEYS = ["sha1", "md5", "alt_sha1", "alt_md5", "sha1_verified", "md5_verified", "alt_sha1_verified", "alt_md5_verified", "header_type", "header_required", "header_from_file"]


def classify(nodes: DataFrame) -> DataFrame:
    """nodes(group_id, parent_id, locked, zero_byte, rep_status, dat_status, allowed, and the hash columns of a group)
    with `new_status`: the zero-byte branch, then steps 1 to 4 and the rename step, each result validated. Every
    predicate reads hashes and first statuses only, so the steps are flags of one plan."""
    s, dat = F.col("rep_status"), F.col("dat_status")
    missing = (s == "Missing") | ((s == "Corrupt") & (dat == "InDatCollect"))
    corrupt = (s == "Corrupt") & (dat != "InDatCollect")
    unneeded = s.isin("UnNeeded", "Unknown", "IncompleteRemove")
    correct, staging = s == "Correct", s == "InToSort"
    role = F.when(missing, "missing").when(correct, "correct").when(unneeded, "unneeded").when(staging, "staging")
    grouped = nodes.where("group_id is not null and not zero_byte").withColumn("role", role)
    # What predicates read of a group's members, each once: members agree on known hashes, so this stays a handful of
    # profiles however many copies a group has, and nothing compares members in pairs.
    profile = F.struct("role", "locked", *FIX_KEYS)
    seen = grouped.where("role is not null").groupBy("group_id").agg(F.collect_set(profile).alias("profiles"))
    out = grouped.join(seen, "group_id", "left")
    own = F.col
    among = lambda test: F.coalesce(F.exists("profiles", test), F.lit(False))
    flags = {
        "has_source": lambda p: (p["role"] != "missing") & fixes(own, lambda k: p[k]),
        "is_wanted": lambda p: (p["role"] == "missing") & fixes(lambda k: p[k], own),
        "is_wanted_unlocked": lambda p: (p["role"] == "missing") & ~p["locked"] & fixes(lambda k: p[k], own),
        "has_correct": lambda p: (p["role"] == "correct") & duplicates(own, lambda k: p[k]),
        "has_staging": lambda p: (p["role"] == "staging") & duplicates(own, lambda k: p[k]),
        "any_got": lambda p: p["role"] != "missing",
    }
    out = out.withColumns({name: among(test) for name, test in flags.items()})
    free = ~F.col("locked")
    first = (
        F.when(missing & free & F.col("has_source"), F.when(s == "Corrupt", F.lit("CorruptCanBeFixed")).otherwise("CanBeFixed"))
        .when(missing & free & (s == "Corrupt"), "MoveToCorrupt")
        .when(corrupt & free & F.col("any_got"), "Delete")
        .when(corrupt & free & (dat != "InToSort"), "MoveToCorrupt")
        .when(unneeded & F.col("is_wanted"), "NeededForFix")
        .when(unneeded & free & (F.col("has_correct") | F.col("has_staging")), "Delete")
        .when(unneeded & free, "MoveToSort")
        .when(staging & F.col("is_wanted_unlocked"), "NeededForFix")
        .when(staging & free & F.col("has_correct"), "Delete")
        .otherwise(s)
    )
    out = out.withColumn("step", first)
    siblings = F.collect_set(F.when(F.col("step") == "CanBeFixed", F.struct(*FIX_KEYS)))
    beside = out.groupBy("group_id", "parent_id").agg(siblings.alias("siblings"))
    out = out.join(beside, ["group_id", "parent_id"], "left").withColumn("has_sibling", F.coalesce(F.exists("siblings", lambda p: fixes(lambda k: p[k], own)), F.lit(False)))
    step = F.when((F.col("step") == "NeededForFix") & F.col("has_sibling"), "Rename").otherwise(F.col("step"))
    zero = (
        F.when(F.col("locked"), s)
        .when(s == "Missing", "CanBeFixed")
        .when(s == "Corrupt", F.when(dat == "InDatCollect", F.lit("CorruptCanBeFixed")).otherwise("Delete"))  # CanBeFixed isn't allowed there
        .when(s.isin("UnNeeded", "Unknown", "IncompleteRemove", "InToSort"), "Delete")
        .otherwise(s)
    )
    columns = nodes.columns
    settle = lambda rows, status: rows.withColumn("new_status", F.when(status == s, s).otherwise(validated(status, F.col("allowed")))).select(*columns, "new_status")
    return (
        settle(out, step)
        .unionByName(settle(nodes.where("group_id is not null and zero_byte"), zero))
        .unionByName(settle(nodes.where("group_id is null"), s))
    )


def partial_sets(nodes: DataFrame) -> DataFrame:
    """Sets under a complete-only rule that miss a file and have (or can have) another: what could be fixed becomes
    Incomplete, what is there IncompleteRemove; what is missing stays so. nodes(parent_id, complete_only, new_status,
    allowed) with partial_status."""
    s = F.col("new_status")
    mixed = nodes.groupBy("parent_id").agg((F.bool_or(s == "Missing") & F.bool_or(s.isin("Correct", "CanBeFixed"))).alias("mixed"))
    out = nodes.join(mixed, "parent_id", "left")
    due = F.col("complete_only") & F.coalesce("mixed", F.lit(False))
    status = F.when(due & (s == "CanBeFixed"), "Incomplete").when(due & (s == "Correct"), "IncompleteRemove").otherwise(s)
    return out.withColumn("partial_status", F.when(status == s, s).otherwise(validated(status, F.col("allowed")))).drop("mixed")


def reclassify(partial: DataFrame) -> DataFrame:
    """After partial_sets(): groups with a file that changed are classified once more, from first statuses but for what is
    incomplete. Adds final_status."""
    changed = F.col("partial_status") != F.col("new_status")
    touched = partial.where(changed & F.col("group_id").isNotNull()).select("group_id").distinct()
    again, rest = partial.join(touched, "group_id", "left_semi"), partial.join(touched, "group_id", "left_anti")
    kept = F.col("partial_status").isin("Incomplete", "IncompleteRemove")
    reset = again.withColumn("first_status", F.col("rep_status")).withColumn("rep_status", F.when(kept, F.col("partial_status")).otherwise(F.col("rep_status"))).withColumnRenamed("new_status", "was_status")
    second = classify(reset).withColumnRenamed("new_status", "final_status").withColumnsRenamed({"was_status": "new_status"}).withColumn("rep_status", F.col("first_status")).drop("first_status")
    return second.unionByName(rest.withColumn("final_status", F.col("partial_status")))


def find_fixes(got: DataFrame, missing: DataFrame, ignore: str | None = None) -> DataFrame:
    """The whole engine on found and missing rows of one schema: groups, first statuses, classification, incomplete sets
    with a second classification of the groups that they touch, and the guard for empty files. What more than one step
    reads is written once: a plan of all steps would read it hundreds of times. Returns the rows with rep_status, new_status, partial_status, final_status and guarded_status."""
    grouped = written(matching.content_groups(got))
    placed = matching.missing_cascade(missing, matching.group_table(grouped)).drop("rank")
    ungrouped = got.where("crc is null").withColumn("group_id", F.lit(None).cast("string"))
    rows = with_default(grouped.unionByName(ungrouped).unionByName(placed), ignore).withColumn("zero_byte", F.coalesce(F.col("group_id") == "zero", F.lit(False)))
    partial = written(partial_sets(classify(written(rows))))
    return zero_byte_guard(written(reclassify(partial)), "final_status")


def zero_byte_guard(nodes: DataFrame, status: str = "new_status") -> DataFrame:
    """In staging archives whose files with bytes all stay (InToSort or Corrupt, one at least), empty files stay as well.
    nodes(parent_id, root_kind, size, and the column of statuses) with guarded_status."""
    s, full = F.col(status), F.col("size") > 0
    stays = nodes.where("root_kind = 'staging'").groupBy("parent_id").agg((F.bool_or(full) & F.bool_and(~full | s.isin("InToSort", "Corrupt"))).alias("stays"))
    out = nodes.join(stays, "parent_id", "left")
    keep = (F.col("root_kind") == "staging") & F.coalesce("stays", F.lit(False)) & (F.col("size") == 0) & (s == "Delete")
    return out.withColumn("guarded_status", F.when(keep, F.lit("InToSort")).otherwise(s)).drop("stays")
