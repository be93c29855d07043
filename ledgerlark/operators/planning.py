"""Plans of repairs; no file is touched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import is_cp437
from ledgerlark.functions.sortkeys import torrent_zip
from ledgerlark.operators import attributes, status
from ledgerlark.sources.archives import EMPTY_ZSTD, FIXED_TIME, STRUCTURES

# For each destination, sources that can be copied raw, in order. _V is verified, _U is not.
RAW = {
    "ZipTrrnt": "ZipTrrnt ZipTDC",
    "ZipTDC": "ZipTDC ZipTrrnt",
    "ZipZSTD": "ZipZSTD 7NZSTD 7SZSTD/SF",
    "Zip": "Zip ZipTDC ZipTrrnt ZipZSTD",
    "SevenZipNLZMA": "7SLZMA/SF 7NLZMA",
    "SevenZipSLZMA_SF": "7SLZMA/SF 7NLZMA",
    "SevenZipSLZMA_MF": "",
    "SevenZipNZSTD": "ZipZSTD 7NZSTD 7SZSTD/SF",
    "SevenZipSZSTD_SF": "ZipZSTD 7NZSTD 7SZSTD/SF",
    "SevenZipSZSTD_MF": "",
    "File": "",
}
#: Families of sources to be unpacked, and those of several files to be extracted, both in order.
UNPACKED = [["ZipZSTD", "7NZSTD", "7SZSTD/SF"], ["ZipTrrnt", "ZipTDC"], ["Zip"], ["7SLZMA/SF", "7NLZMA"], ["7Trrnt/SF"], ["7/SF"]]
EXTRACTED = ["7SZSTD/MF", "7SLZMA/MF", "7Trrnt/MF", "7/MF"]


def _name(source: str, verified: str) -> str:
    kind, _, files = source.partition("/")
    return f"{kind}_{verified}" + (f"_{files}" if files else "")


def priorities() -> list[tuple[str, str, int, str]]:
    """(destination, source, rank, style): raw copies first, verified before unverified, then a plain file, then what
    must be unpacked (families in order, each verified first), then what must be extracted whole."""
    out = []
    for to, raw in RAW.items():
        own = raw.split()
        order = [(_name(s, "V"), "RawCopy") for s in own] + [(_name(s, "U"), "RawCopyOnceVerified") for s in own] + [("File_V", "Compress")]
        for family in UNPACKED:
            rest = [s for s in family if s not in own]
            order += [(_name(s, v), "DecompressRecompress") for v in "VU" for s in rest]
        order += [(_name(s, v), "ExtractToCache") for s in EXTRACTED for v in "VU"]
        out += [(to, s, i, style) for i, (s, style) in enumerate(order)]
    return out


def style_at_level(style: Column, level: int) -> Column:
    """How a file is copied after all at a fix level."""
    if level == 1:
        style = F.when(style == "RawCopyOnceVerified", "RawCopy").otherwise(style)
    if level == 3:
        style = F.when(style == "RawCopy", "DecompressRecompress").otherwise(style)
    return F.when(style.isin("RawCopyOnceVerified", "Compress"), "DecompressRecompress").otherwise(style)


# Structures of archives and how sources and destinations of each are called.
_SEVEN = {"SevenZipSLZMA": "7SLZMA", "SevenZipNLZMA": "7NLZMA", "SevenZipSZSTD": "7SZSTD", "SevenZipNZSTD": "7NZSTD", "SevenZipTrrnt": "7Trrnt", "None": "7"}
_ZIP = {"ZipTrrnt": "ZipTrrnt", "ZipTDC": "ZipTDC", "ZipZSTD": "ZipZSTD", "None": "Zip", "ZipDTD": "Zip"}
_TO = {"None": "Zip", "ZipTrrnt": "ZipTrrnt", "ZipTDC": "ZipTDC", "ZipZSTD": "ZipZSTD", "SevenZipSLZMA": "SevenZipSLZMA_MF", "SevenZipNLZMA": "SevenZipNLZMA", "SevenZipSZSTD": "SevenZipSZSTD_MF", "SevenZipNZSTD": "SevenZipNZSTD"}


def _named(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def source_kind(file_type: Column, structure: Column, verified: Column, single: Column) -> Column:
    """How a found file counts as a source: by its archive's structure, whether it is deep-scanned, and in solid 7z archives
    whether it is the only file there. Null for structures that a source can't have."""
    mark = F.when(verified, "_V").otherwise("_U")
    solid = ~structure.isin("SevenZipNLZMA", "SevenZipNZSTD")
    seven = F.concat(_named(_SEVEN, structure), mark, F.when(solid, F.when(single, "_SF").otherwise("_MF")).otherwise(""))
    return F.when(file_type == "File", "File_V").when(file_type == "FileZip", F.concat(_named(_ZIP, structure), mark)).when(file_type == "FileSevenZip", seven)


def destination_kind(file_type: Column, archive_type: Column, structure: Column, default_seven: str = "SevenZipNZSTD") -> Column:
    """What a fix is written to; a 7z archive of no or of the fixed-dictionary structure is made in the default one."""
    own = F.when((archive_type == "SevenZip") & structure.isin("None", "SevenZipTrrnt"), default_seven).otherwise(structure)
    return F.when(file_type == "File", "File").when(file_type.isin("FileZip", "FileSevenZip"), _named(_TO, own))


def single_files(members: DataFrame) -> DataFrame:
    """members(archive, got_status) to (archive, single): one file, found or corrupt, and no more."""
    return members.where("got_status in ('Got', 'Corrupt')").groupBy("archive").agg((F.count("*") == 1).alias("single"))


def fix_source(wanted: DataFrame, sources: DataFrame, level: int = 2) -> DataFrame:
    """wanted(group_id, dest_id, dest_kind, zero, and the columns that status.fixes reads), sources(group_id, source_id,
    source_kind, and the same columns): all sources of the best rank among those that may fix. What has no bytes needs
    no source (style Zero). Ranks are settled per group, kind and profile of hashes before single sources are looked at."""
    keys = status.FIX_KEYS
    table = wanted.sparkSession.createDataFrame(priorities(), "dest_kind string, source_kind string, rank int, style string")
    as_profile = lambda df, name: df.withColumn(name, F.struct(*keys))
    full, zero = as_profile(wanted.where("not zero"), "want"), wanted.where("zero")
    have = as_profile(sources, "got")
    asked, kinds = full.select("group_id", "dest_kind", "want").distinct(), have.select("group_id", "source_kind", "got").distinct()
    ok = status.fixes(lambda k: F.col(f"want.{k}"), lambda k: F.col(f"got.{k}"))
    ranked = asked.join(kinds, "group_id").where(ok).join(F.broadcast(table), ["dest_kind", "source_kind"])  # 319 rows
    place = ["group_id", "dest_kind", "want"]
    best = ranked.groupBy(*place).agg(F.min("rank").alias("rank"), F.min_by(F.struct("source_kind", "style"), "rank").alias("b"), F.collect_set(F.struct("rank", "got")).alias("all"))
    best = best.select(*place, "rank", "b.source_kind", style_at_level(F.col("b.style"), level).alias("style"), F.explode(F.filter("all", lambda x: x["rank"] == F.col("rank"))).alias("x")).withColumn("got", F.col("x.got"))
    best = best.select(F.col("group_id").alias("b_group"), F.col("dest_kind").alias("b_kind"), F.col("want").alias("b_want"), "rank", "source_kind", "style", F.col("got").alias("b_got"))
    chosen = full.select("dest_id", "group_id", "dest_kind", "want").join(best, (F.col("group_id") == F.col("b_group")) & (F.col("dest_kind") == F.col("b_kind")) & F.col("want").eqNullSafe(F.col("b_want"))).select("dest_id", "b_group", "source_kind", "b_got", "rank", "style")
    there = have.select("source_id", "group_id", F.col("source_kind").alias("s_kind"), "got")
    match = (F.col("group_id") == F.col("b_group")) & (F.col("s_kind") == F.col("source_kind")) & F.col("got").eqNullSafe(F.col("b_got"))
    out = chosen.join(there, match).select("dest_id", "source_id", "source_kind", "rank", "style")
    none = zero.select("dest_id", F.lit(None).cast("long").alias("source_id"), F.lit(None).cast("string").alias("source_kind"), F.lit(None).cast("int").alias("rank"), F.lit("Zero").alias("style"))
    return out.unionByName(none)


#: Statuses of a file that is there and stays.
LIVE = ["Unknown", "Correct", "InToSort", "Rename", "NeededForFix", "MoveToSort", "Ignore"]


def safe_delete(nodes: DataFrame) -> DataFrame:
    """Rows to delete, with `safe`: another copy that could replace them stays, or they have no bytes, or they are cue
    sheets in staging. nodes(group_id, new_status, got_status, root_kind, name, size, and what status.fixes reads)."""
    keys = status.FIX_KEYS
    live = nodes.where((F.col("got_status") == "Got") & F.col("new_status").isin(LIVE) & F.col("group_id").isNotNull()).groupBy("group_id").agg(F.collect_set(F.struct(*keys)).alias("live"))
    found = F.coalesce(F.exists("live", lambda p: status.fixes(F.col, lambda k: p[k])), F.lit(False))
    exempt = ((F.col("root_kind") == "staging") & F.lower("name").endswith(".cue")) | attributes.zero_length()
    return nodes.where("new_status = 'Delete'").join(live, "group_id", "left").withColumn("safe", found | F.coalesce(exempt, F.lit(False))).drop("live")


def release_sources(nodes: DataFrame, renames: bool = False) -> DataFrame:
    """Sources kept for fixes (and renames, if asked) go when no fix of their content is left; locked ones go back to what
    they were. nodes(group_id, new_status, locked, root_kind) with `released`."""
    left = nodes.where("group_id is not null").groupBy("group_id").agg(F.bool_or(F.col("new_status") == "CanBeFixed").alias("left"))
    used = F.col("new_status").isin(["NeededForFix", "Rename"] if renames else ["NeededForFix"])
    back = F.when(F.col("root_kind") == "staging", "InToSort").otherwise("Unknown")
    status_now = F.when(used & F.col("locked"), back).when(used & ~F.coalesce("left", F.lit(False)), "Delete").otherwise(F.col("new_status"))
    return nodes.join(left, "group_id", "left").withColumn("released", status_now).drop("left")


def archive_move(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(dest, source, n): archives whose live members are just the wanted ones of another, by place, name, size and SHA1.
    Both sides: (archive, place, name, size, sha1); found may tell sha1_verified and header_type: an archive with a member
    that isn't verified, or has a header, is no source. Candidates agree in sums of their members' hashes; their members
    are then compared one by one, so nothing gathers an archive in one row."""
    member = F.xxhash64("place", "name", "size", "sha1")
    kind = ["place", "name", "size", "sha1"]

    def digest(rows: DataFrame, name: str) -> DataFrame:
        fit = F.lit(True)
        if name == "source":
            for c, ok in (("sha1_verified", F.coalesce("sha1_verified", F.lit(False))), ("header_type", F.col("header_type").isNull())):
                fit = fit & ok if c in rows.columns else fit
        return rows.groupBy(F.col("archive").alias(name)).agg(F.sum(member.cast("decimal(20,0)")).alias("total"), F.bit_xor(member).alias("mixed"), F.count("*").alias("n"), F.bool_and(fit).alias("fit")).where("fit").drop("fit")

    pairs = digest(wanted, "dest").join(digest(found, "source"), ["total", "mixed", "n"]).where("dest <> source").select("dest", "source", "n")
    counted = lambda rows, name: rows.groupBy(F.col("archive").alias(name), *kind).agg(F.count("*").alias(f"of_{name}"))
    ours, theirs = pairs.join(counted(wanted, "dest"), "dest"), counted(found, "source")
    match = [ours["source"] == theirs["source"], *(ours[k].eqNullSafe(theirs[k]) for k in kind), ours["of_dest"] == theirs["of_source"]]
    agreed = ours.join(theirs, match).groupBy(ours["dest"], ours["source"], ours["n"]).agg(F.sum("of_dest").alias("matched"))
    return agreed.where("matched = n").select("dest", "source", "n")


def archive_structure(members: DataFrame) -> DataFrame:
    """members(archive, place, name): flags an archive's faults in its central directory's order: 1 backslashes,
    2 not in order, 4 repeated names, 8 directory entries that later names imply."""
    order = Window.partitionBy("archive").orderBy("place")
    name, key = F.col("name"), F.lower("name")
    before = F.lag(key).over(order)
    flags = members.select(
        "archive",
        F.when(F.contains(name, F.lit("\\")), 1).otherwise(0).alias("slash"),
        F.when(before > key, 2).otherwise(0).alias("order"),
        F.when(before == key, 4).otherwise(0).alias("repeat"),
        F.when(name.endswith("/") & F.coalesce(F.startswith(F.lead(name).over(order), name), F.lit(False)), 8).otherwise(0).alias("dir"),
    )
    return flags.groupBy("archive").agg((F.bit_or("slash").bitwiseOR(F.bit_or("order")).bitwiseOR(F.bit_or("repeat")).bitwiseOR(F.bit_or("dir"))).alias("flags"), F.count("*").alias("n_members"))


def valid_structure(members: DataFrame) -> DataFrame:
    """members as archives.read_members() has them, with `archive`: (archive, structure), the structure that its comment
    claims if every member keeps to it, else None: method and time of the structure, local headers that agree, UTF-8 just
    for names outside code page 437, no backslashes, names in order (A-Z folded) and once, no directory entries that the
    next name implies, and the one right stream for empty members under zstd."""
    by_kind = lambda i: F.try_element_at(F.create_map(*(F.lit(x) for kind, rule in STRUCTURES.items() for x in (kind, rule[i]))), F.col("claimed"))
    order = Window.partitionBy("archive").orderBy("place")
    key = torrent_zip(F.col("name"))[0]
    after = F.lead(key).over(order)
    dates = by_kind(2)
    zstd_zero = (F.col("packed_size") == len(EMPTY_ZSTD) // 2) & (F.lower(F.hex("packed_head")) == EMPTY_ZSTD)
    kept = [
        F.col("header_ok"),
        F.col("method") == by_kind(1),
        (dates == "any") | (F.col("dos_time") == F.when(dates == "fixed", FIXED_TIME).otherwise(0)),
        is_cp437(F.col("name")) != F.col("utf8"),
        ~F.contains("name", F.lit("\\")),
        after.isNull() | (after > key),
        ~F.col("claimed").isin("ZipTrrnt", "ZipZSTD") | after.isNull() | ~((key == "") | key.endswith("/")) | ~F.startswith(after, key),
        (F.col("claimed") != "ZipZSTD") | (F.col("size") > 0) | zstd_zero,
    ]
    ruled = members.select("archive", "claimed", F.coalesce(reduce(lambda a, b: a & b, kept), F.lit(False)).alias("kept"))
    return ruled.groupBy("archive").agg(F.when(F.bool_and("kept"), F.max("claimed")).otherwise("None").alias("structure"))


def staging_names(moves: DataFrame) -> DataFrame:
    """moves(node_id, target, name): names in the staging directory; from the second on, _0, _1, ... before the extension."""
    place = F.row_number().over(Window.partitionBy("target", F.lower("name")).orderBy("node_id")) - 2
    numbered = F.concat(F.regexp_replace("name", r"\.[^./]*$", ""), F.lit("_"), F.col("n").cast("string"), F.regexp_extract("name", r"(\.[^./]*)$", 1))
    return moves.withColumn("n", place).withColumn("staged", F.when(F.col("n") >= 0, numbered).otherwise(F.col("name"))).drop("n")


def empty_directories(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """dirs(path) below which no file stays. files(path of the directory); every leading part of it counts as used."""
    parts = F.split("path", "/")
    used = files.select("path").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("path")).distinct()
    return dirs.join(used, "path", "left_anti")


# What is done about a file of each status, alone in a directory and in an archive that is rebuilt.
FILE_ACTIONS = {
    "UnScanned": "keep", "Missing": "keep", "Incomplete": "keep", "Correct": "check_name", "NotCollected": "keep", "Ignore": "keep", "InToSort": "keep",
    "Delete": "delete", "MoveToSort": "move_to_staging", "MoveToCorrupt": "move_to_corrupt", "CanBeFixed": "fix", "CorruptCanBeFixed": "fix", "NeededForFix": "keep",
    "Corrupt": "keep", "Rename": "keep",
}
MEMBER_ACTIONS = {
    "Missing": "leave_out", "NotCollected": "leave_out", "Rename": "leave_out", "Delete": "leave_out", "Incomplete": "leave_out",
    "Correct": "copy", "InToSort": "copy", "NeededForFix": "copy", "Corrupt": "copy", "CanBeFixed": "fix", "CorruptCanBeFixed": "fix",
    "MoveToSort": "move_to_staging", "MoveToCorrupt": "move_to_corrupt",
}


def _action(actions: dict[str, str], status: Column) -> Column:
    pairs = (F.lit(x) for pair in actions.items() for x in pair)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), status), F.lit("error"))


def file_action(status: Column) -> Column:
    """What is to be done about a plain file; statuses that a file can't have are errors."""
    return _action(FILE_ACTIONS, status)


def member_action(status: Column) -> Column:
    """What becomes of an archive's member when the archive is rebuilt."""
    return _action(MEMBER_ACTIONS, status)


def archive_actions(members: DataFrame, archives: DataFrame) -> DataFrame:
    """members(archive, new_status), archives(archive, corrupt, structure, wanted_structure) with `action`: a corrupt
    archive moves as a whole; one whose members all leave (or aren't there) is staged as a whole; one without anything to
    keep is deleted; one with something to do, or of another structure than wanted, is rebuilt; the rest stays."""
    leaves, absent = ["MoveToSort", "Missing", "NotCollected"], ["Missing", "NotCollected", "Incomplete"]
    busy = [s for s, a in MEMBER_ACTIONS.items() if a not in ("copy", "leave_out")] + ["Delete", "Rename"]
    sums = members.groupBy("archive").agg(
        F.bool_and(F.col("new_status").isin(leaves)).alias("all_leave"), F.bool_or(F.col("new_status") == "MoveToSort").alias("any_leaves"),
        F.bool_and(F.col("new_status").isin([*absent, "Delete"])).alias("none_stays"), F.bool_or(F.col("new_status") == "Delete").alias("any_delete"), F.bool_or(F.col("new_status").isin(busy)).alias("busy"),
    )
    joined = archives.join(sums, "archive", "left")
    known = lambda c: F.coalesce(c, F.lit(False))
    action = (
        F.when(known("corrupt"), "move_to_corrupt")
        .when(known(F.col("all_leave") & F.col("any_leaves")), "move_to_staging")
        .when(known(F.col("none_stays") & F.col("any_delete")), "delete")
        .when(known("busy") | restructure(F.col("structure"), F.col("wanted_structure")), "rebuild")
        .otherwise("keep")
    )
    return joined.withColumn("action", action).select(*archives.columns, "action")


def restructure(structure: Column, wanted: Column) -> Column:
    """An archive needs rebuilding when a structure is wanted that it doesn't have."""
    return F.coalesce((wanted != "None") & ~structure.eqNullSafe(wanted), F.lit(False))


def reset_corrupt_time(nodes: DataFrame) -> DataFrame:
    """Corrupt files lose their time, so that the next scan reads them again."""
    return nodes.withColumn("mtime", F.when(F.col("got_status") != "Corrupt", F.col("mtime")))
