"""Steps that clean a catalog: filters, levels, packing, file types, dates, disks. Each is a projection, a filter, or one
keyed aggregation that is joined back; catalogs may be of any size.

Items: (cat_id, set_name, name, size, crc, sha1, status, is_disk, ...); set_name is null for loose files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import stem
from ledgerlark.operators import catalogs, matching

# The date of all members of a TorrentZip archive (1996-12-24 23:32), packed as DOS does.
TORRENT_ZIP_DATE = 0x2198BC00
MEMBER_TYPES = {"Dir": "File", "Zip": "FileZip", "SevenZip": "FileSevenZip"}
DATED_STRUCTURES = ("ZipTDC", "ZipDTD", "ZipDTZ")


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), key)


def by_disk(items: DataFrame, keep: str = "all") -> DataFrame:
    """keep: all, disks or files."""
    return {"all": items, "disks": items.where("is_disk"), "files": items.where("not is_disk")}[keep]


def without_nodumps(items: DataFrame) -> DataFrame:
    """Items of sets that nobody has dumped go; loose ones stay."""
    return items.where(~(F.col("set_name").isNotNull() & F.coalesce(F.lower("status") == "nodump", F.lit(False))))


def cleared(items: DataFrame, *columns: str) -> DataFrame:
    """Columns emptied: dates, single hashes, device references."""
    return items.withColumns({c: F.lit(None).cast(items.schema[c].dataType) for c in columns})


def only_collected(items: DataFrame) -> DataFrame:
    return items.where(F.col("dat_status").isin("InDatCollect", "InDatNoDump"))


def without_loose_files(items: DataFrame) -> DataFrame:
    return items.where("set_name is not null")


def without_devices(sets: DataFrame) -> DataFrame:
    """Devices that can't be run go; a set that doesn't say is none."""
    return sets.where(~(F.coalesce(F.lower("isdevice") == "yes", F.lit(False)) & F.coalesce(F.lower("runnable") == "no", F.lit(False))))


def merge_kind(rule: Column, overrides: Column, header: Column) -> Column:
    """The rule's way of merging, or the catalog's own unless the rule overrides it."""
    own = _lookup({"full": "Merge", "nonmerge": "NonMerged", "split": "Split"}, F.lower(header))
    return F.when(overrides, rule).otherwise(F.coalesce(own, rule))


def merge_text(merge: Column, dat_status: Column) -> Column:
    """The merge name of an item that isn't merged says so."""
    given = F.nullif(merge, F.lit(""))
    return F.when(given.isNotNull() & (dat_status != "InDatMerged"), F.concat(F.lit("(No-Merge) "), given)).otherwise(merge)


def packing(rule_type: Column, rule_structure: Column, overrides: Column, header: Column) -> Column:
    """struct(file_type, structure) from the rule, or from the catalog's forcepacking unless the rule overrides it or asks
    for plain files."""
    of = lambda kind, structure: F.struct(F.lit(kind).alias("file_type"), F.lit(structure).alias("structure"))
    own, word = F.struct(rule_type.alias("file_type"), rule_structure.alias("structure")), F.lower(header)
    return (
        F.when(rule_type == "FileOnly", of("Dir", "None"))
        .when(overrides, own)
        .when(word == "tdc", of("Zip", "ZipTDC"))
        .when(word.isin("unzip", "file", "fileonly"), of("Dir", "None"))
        .when(word.isin("7zip", "7z"), of("SevenZip", "SevenZipSLZMA"))
        .when(word == "zip", of("Zip", "ZipTrrnt"))
        .otherwise(own)
    )


def flatten_directories(sets: DataFrame) -> DataFrame:
    """sets(dirs array<string>, name): names lead by their directories, on the level of sets."""
    return sets.withColumn("name", F.concat_ws("/", F.coalesce("dirs", F.array().cast("array<string>")), F.array("name"))).drop("dirs")


def single_level(items: DataFrame, policy: str = "keep_all", category: Column | None = None) -> DataFrame:
    """Collapse a catalog's sets into one: flat_name is an item's name there. A set's name stays in front by policy:
    keep_all (always), remove_all (never), remove_all_if_no_conflicts (always if any two items of the catalog would then
    have one name, whatever its case), remove_if_single (unless it has one item), remove_if_name_matches (unless it has
    one item, named like it but for the extension). A category leads the set's name already; where that name goes,
    the category leads the item's."""
    led = F.nullif(category, F.lit("")) if category is not None else F.lit(None).cast("string")
    with_category = lambda name: F.when(led.isNull(), name).otherwise(F.concat_ws("/", led, name))
    if policy == "remove_all_if_no_conflicts":
        clashes = items.groupBy("cat_id", F.lower("name").alias("key")).agg(F.count("*").alias("n")).groupBy("cat_id").agg((F.max("n") > 1).alias("stays_"))
        known = items.join(clashes, "cat_id")
    elif policy in ("remove_if_single", "remove_if_name_matches"):
        known = items.join(items.groupBy("cat_id", "set_name").agg((F.count("*") > 1).alias("stays_")), ["cat_id", "set_name"])
        if policy == "remove_if_name_matches":
            known = known.withColumn("stays_", F.col("stays_") | (with_category(stem(F.col("name"))) != F.col("set_name")))
    else:
        known = items.withColumn("stays_", F.lit({"keep_all": True, "remove_all": False}[policy]))
    return known.withColumn("flat_name", F.when(F.col("stays_"), F.concat_ws("/", "set_name", "name")).otherwise(with_category(F.col("name")))).drop("stays_")


def set_types(sets: DataFrame, items: DataFrame, file_type: str, structure: str) -> DataFrame:
    """sets(cat_id, set_name, own_type) with file_type, structure and member_type. A set's own type wins over the
    catalog's, but not over plain directories; a dated zip whose members all have TorrentZip's date is a TorrentZip."""
    dates = items.groupBy("cat_id", "set_name").agg(F.bool_and(F.coalesce(F.col("date_modified") == TORRENT_ZIP_DATE, F.lit(False))).alias("plain_"))
    typed = sets.join(dates, ["cat_id", "set_name"], "left")
    own = F.when(F.lit(file_type) == "Dir", F.lit("Dir")).otherwise(F.coalesce("own_type", F.lit(file_type)))
    packed = _lookup({"Dir": "None", "Zip": "ZipTrrnt", "SevenZip": "SevenZipNZSTD"}, F.col("own_type"))
    given = F.when(F.lit(file_type) == "Dir", F.lit("None")).otherwise(F.coalesce(packed, F.lit(structure)))
    typed = typed.withColumns({"file_type": own, "structure": given})
    same = (F.col("file_type") == "Zip") & (F.col("structure") == "ZipTDC") & F.coalesce("plain_", F.lit(True))
    return typed.withColumns({"structure": F.when(same, "ZipTrrnt").otherwise(F.col("structure")), "member_type": _lookup(MEMBER_TYPES, F.col("file_type"))}).drop("plain_")


def clear_dates(items: DataFrame) -> DataFrame:
    """Dates stay only in archives that are ordered with their dates."""
    return items.withColumn("date_modified", F.when(F.col("structure").isin(*DATED_STRUCTURES), F.col("date_modified")))


def move_up_disks(items: DataFrame) -> DataFrame:
    """items(is_disk, file_type of the set): disks leave archives for a directory of the set's name beside them."""
    out = F.col("is_disk") & F.col("file_type").isin("Zip", "SevenZip")
    return items.withColumns({"container_type": F.when(out, "Dir").otherwise(F.col("file_type")), "member_type": F.when(out, "File").otherwise(_lookup(MEMBER_TYPES, F.col("file_type")))})


def header_rule(found: Column, rule: Column) -> Column:
    """struct(type, required): what the catalog says of headers, under the rule Optional, Headerless or Headered."""
    return F.struct(F.when(rule != "Headerless", found).alias("type"), (found.isNotNull() & (rule == "Headered")).alias("required"))


def clear_description(name: Column, description: Column) -> Column:
    """A description that only repeats the set's name goes."""
    return F.when(~F.coalesce(stem(name) == description, F.lit(False)), description)


def flatten_archives(items: DataFrame) -> DataFrame:
    """Items of nested directories under one name each, and a 'dir/' entry (size 0, CRC 0) for every directory."""
    marks = catalogs.expand_dirs(items).select("set_name", F.concat("dir", F.lit("/")).alias("name"), F.lit(0).cast("long").alias("size"), F.lit("00000000").alias("crc"))
    return items.select("set_name", "name", F.col("size").cast("long").alias("size"), "crc").unionByName(marks)


def first_level_as_sets(items: DataFrame) -> DataFrame:
    """The top directory of a loose file's path becomes its set; the rest is its name."""
    top = F.regexp_extract("name", "^([^/]*)/", 1)
    loose = F.col("set_name").isNull() & (top != "")
    return items.withColumns({"set_name": F.when(loose, top).otherwise(F.col("set_name")), "name": F.when(loose, F.regexp_replace("name", "^[^/]*/", "")).otherwise(F.col("name"))})


def archives_as_sets(nodes: DataFrame) -> DataFrame:
    """nodes(set_name, file_type, name, archive): members of archives without a set get their archive's stem as set."""
    return nodes.withColumn("set_name", F.coalesce("set_name", F.when(F.col("file_type").isin("FileZip", "FileSevenZip"), stem(F.col("archive")))))


def without_empty_directories(dirs: DataFrame, children: DataFrame) -> DataFrame:
    """dirs(path) that have a child; children(parent)."""
    return dirs.join(children.select(F.col("parent").alias("path")).distinct(), "path", "left_semi")


def apply_merge(sets: DataFrame, items: DataFrame, kind: str, refs: DataFrame | None = None) -> DataFrame:
    """(item_id, home, item_name, dat_status) of one catalog's items, its sets merged by kind: Merge, NonMerged, Split
    or None. With NonMerged, items of the devices in refs(cat_id, set_name, device) join the sets that reach them. sets(cat_id, name, id, cloneof_id, cloneof, romof, is_bios, ord). Catalogs none of whose sets has a
    parent are left alone; then and else, items that repeat in their home are reduced to one, but not for NonMerged."""
    parents = F.coalesce(F.when(F.col("romof") != F.col("name"), F.col("romof")), F.when(F.col("cloneof") != F.col("name"), F.col("cloneof")))
    matched = catalogs.match_ids(sets).withColumn("parent", parents)
    chain = catalogs.parent_chain(matched)
    if kind == "Split":
        out = catalogs.split_sets(items, chain).select("*", F.col("set_name").alias("home"), F.col("name").alias("item_name"))
    elif kind == "Merge":
        out = catalogs.merge_sets(items, chain, matched.where("is_bios")).withColumn("dat_status", F.lit("InDatCollect"))
    else:
        out = items.select("*", F.col("set_name").alias("home"), F.col("name").alias("item_name"), F.lit("InDatCollect").alias("dat_status"))
    if kind == "NonMerged" and refs is not None:
        pulled = catalogs.non_merge_sets(items, refs).select("item_id", F.col("set_name").alias("home"))
        out = out.unionByName(items.join(pulled, "item_id").select(*items.columns, "home", F.col("name").alias("item_name"), F.lit("InDatCollect").alias("dat_status")))
    if kind != "NonMerged":
        named = out.drop("set_name", "name").withColumns({"set_id": F.concat_ws("\x01", "cat_id", "home"), "name": F.col("item_name")})
        out = matching.remove_dupes(named)
    return out.select("item_id", "home", "item_name", "dat_status")
