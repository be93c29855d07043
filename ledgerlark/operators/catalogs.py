"""Catalog transforms: names, sets, parents, levels. Rows are catalog items or sets; `ord` is the catalog's order."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import agrees, extension, stem
from ledgerlark.sources.scratch import written

EXTENSIONS = {"Zip": ".zip", "SevenZip": ".7z", "Disk": ".chd"}
# The order of categories that a rule has unless it names its own.
CATEGORY_ORDER = ["Preproduction", "Educational", "Guides", "Manuals", "Magazines", "Documents", "Audio", "Video", "Multimedia", "Coverdiscs", "Covermount", "Bonus Discs", "Bonus", "Add-Ons", "Source Code", "Updates", "Applications", "Demos", "Games", "Miscellaneous"]


def item_status(status: Column, merged: Column) -> Column:
    """Dat status of an item: merged ones stay merged, dumps that nobody has are marked, the rest is collected."""
    return F.when(merged, "InDatMerged").when(F.lower(status) == "nodump", "InDatNoDump").otherwise("InDatCollect")


def mia_from_dat(mia: Column, size: Column) -> Column:
    """An unknown size counts as not zero."""
    return F.coalesce(F.lower(mia) == "yes", F.lit(False)) & ~size.eqNullSafe(F.lit(0))


def deduped(status: Column, dat_status: Column, non_merged_rule: Column) -> Column:
    return F.when((F.lower(status) == "deduped") & ~non_merged_rule, "InDatMerged").otherwise(dat_status)


def clean_names_full(name: Column, in_archive: Column) -> Column:
    """Trim blanks, and outside archives trailing dots; what is left blank becomes an underscore."""
    trimmed = F.trim(name)
    trimmed = F.when(in_archive, trimmed).otherwise(F.regexp_replace(trimmed, r"[. ]+$", ""))
    return F.when(trimmed == "", "_").otherwise(trimmed)


def fix_dupes(items: DataFrame) -> DataFrame:
    """Names equal but for case in one parent and type: from the second on, _0, _1, ... before the extension."""
    place = F.row_number().over(Window.partitionBy("parent_id", "file_type", F.lower("name")).orderBy("ord")) - 2
    named = F.concat(F.regexp_replace("name", r"\.[^./]*$", ""), F.lit("_"), F.col("n").cast("string"), extension(F.col("name")))
    return items.withColumn("n", place).withColumn("fixed_name", F.when(F.col("n") >= 0, named).otherwise(F.col("name"))).drop("n")


def set_ext(name: Column, file_type: Column) -> Column:
    out = name
    for kind, ext in EXTENSIONS.items():
        out = F.when(file_type == kind, F.concat(name, F.lit(ext))).otherwise(out)
    return out


def carry_id(sets: DataFrame) -> DataFrame:
    """The last id seen in catalog order goes in front of each name."""
    before = Window.partitionBy("cat_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last("id", True).over(before)
    return sets.withColumn("full_name", F.when(carried.isNotNull(), F.concat_ws(" - ", carried, "name")).otherwise(F.col("name")))


def match_ids(sets: DataFrame) -> DataFrame:
    """clone_of by name from clone_of_id: the first set of the catalog that has that id."""
    first = sets.where("id is not null").groupBy("cat_id", F.col("id").alias("cloneof_id")).agg(F.min_by("name", "ord").alias("found"))
    return sets.join(first, ["cat_id", "cloneof_id"], "left").withColumn("cloneof", F.coalesce("found", "cloneof")).drop("found")


def best_category(categories: Column, order: list[str]) -> Column:
    """The only category, or of several the one that comes first in the order, whatever its case; unlisted ones last."""
    ranks = F.create_map(*(x for i, c in enumerate(order) for x in (F.lit(c.lower()), F.lit(i))))
    ranked = F.transform(categories, lambda c: F.struct(F.coalesce(F.try_element_at(ranks, F.lower(c)), F.lit(len(order))).alias("rank"), c.alias("category")))
    return F.array_min(ranked)["category"]


def parent_chain(sets: DataFrame) -> DataFrame:
    """sets(cat_id, name, parent): every (cat_id, name, ancestor, depth), nearest first. Chains are doubled: the ancestors
    of the furthest known ancestor join a set's own, so a chain of n levels takes about log2 n rounds, each a written table
    without a bound on rows. An ancestor counts at its least depth and no set is its own, which ends cycles."""
    names = sets.select("cat_id", "name").distinct()
    own = sets.where("parent <> name").select("cat_id", "name", F.col("parent").alias("ancestor")).join(names.withColumnRenamed("name", "ancestor"), ["cat_id", "ancestor"], "left_semi")
    chain = written(own.select("cat_id", "name", "ancestor", F.lit(1).alias("depth")).distinct())
    reach, size = 1, chain.count()
    while size:
        last = chain.where(F.col("depth") == reach).select("cat_id", "name", F.col("ancestor").alias("via"))
        above = chain.select("cat_id", F.col("name").alias("via"), "ancestor", (F.col("depth") + reach).alias("depth"))
        more = last.join(above, ["cat_id", "via"]).where("ancestor <> name").select("cat_id", "name", "ancestor", "depth")
        after = written(chain.unionByName(more).groupBy("cat_id", "name", "ancestor").agg(F.min("depth").alias("depth")))
        reach, was, size = 2 * reach, size, after.count()
        chain = after
        if size == was:
            break
    return chain


def reachable(refs: DataFrame) -> DataFrame:
    """refs(cat_id, set_name, device): all devices that a set reaches, itself left out. Paths are doubled, as in
    parent_chain; what is kept are distinct pairs, not paths."""
    pairs = written(refs.select("cat_id", "set_name", "device").dropna().where("set_name <> device").distinct())
    size = pairs.count()
    while size:
        further = pairs.withColumnRenamed("device", "via").join(pairs.withColumnRenamed("set_name", "via"), ["cat_id", "via"]).where("set_name <> device")
        after = written(pairs.unionByName(further.select("cat_id", "set_name", "device")).distinct())
        was, size = size, after.count()
        pairs = after
        if size == was:
            break
    return pairs


_KEYS = ["crc", "sha1", "md5", "sha256"]


def _in_ancestors(items: DataFrame, chain: DataFrame, bios: DataFrame | None = None) -> DataFrame:
    """item_ids of items that an ancestor set has as well, by null-tolerant hashes (crc, sha1 and, if there, md5 and
    sha256). Pairs that share a known hash are found by a join on that hash; pairs that have none to compare by a join on
    what they know: an item meets only what an ancestor knows of hashes that the item lacks, in distinct sizes."""
    keys = [k for k in _KEYS if k in items.columns]
    up = chain if bios is None else chain.join(bios, (chain["cat_id"] == bios["b_cat_id"]) & (chain["ancestor"] == bios["b_name"]), "left_semi")
    mask = sum((F.when(F.col(k).isNotNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)), F.lit(0))
    rows = items.withColumn("mask", mask)
    own = rows.join(up.select("cat_id", F.col("name").alias("set_name"), "ancestor"), ["cat_id", "set_name"]).select("item_id", "cat_id", "ancestor", "is_disk", "size", "mask", *keys)
    theirs = rows.select("cat_id", F.col("set_name").alias("ancestor"), "is_disk", F.col("size").alias("a_size"), F.col("mask").alias("a_mask"), *(F.col(k).alias(f"a_{k}") for k in keys))
    same = agrees(F.col("size"), F.col("a_size"))
    for k in keys:
        same = same & agrees(F.col(k), F.col(f"a_{k}"))
    at, found = ["cat_id", "ancestor", "is_disk"], []
    for k in keys:
        found.append(own.where(f"{k} is not null").withColumn("key", F.col(k)).join(theirs.where(f"a_{k} is not null").withColumn("key", F.col(f"a_{k}")), [*at, "key"]).where(same).select("item_id"))
    apart = F.filter(F.sequence(F.lit(0), F.lit((1 << len(keys)) - 1)), lambda m: m.bitwiseAND(F.col("mask")) == 0)
    sizes = theirs.select(*at, "a_mask", "a_size").distinct()
    found.append(own.withColumn("a_mask", F.explode(apart)).join(sizes, [*at, "a_mask"]).where(agrees(F.col("size"), F.col("a_size"))).select("item_id"))
    return functools.reduce(DataFrame.union, found).distinct()


def split_sets(items: DataFrame, chain: DataFrame) -> DataFrame:
    """Items that any ancestor has too become InDatMerged; nodump items are exempt."""
    hit = _in_ancestors(items, chain).withColumn("merged", F.lit(True))
    merged = F.coalesce("merged", F.lit(False)) & ~F.coalesce(F.lower("status") == "nodump", F.lit(False))
    return items.join(hit, "item_id", "left").withColumn("dat_status", F.when(merged, "InDatMerged").otherwise("InDatCollect")).drop("merged")


def merge_sets(items: DataFrame, chain: DataFrame, bios: DataFrame, with_set_name: bool = True) -> DataFrame:
    """Items that a BIOS ancestor has go, but not those that nobody has dumped; the others move to the last ancestor that
    is no BIOS, their names led by their set's (with_set_name), but for disks."""
    named = bios.select(F.col("cat_id").alias("b_cat_id"), F.col("name").alias("b_name"))
    dumped = items.where(~F.coalesce(F.col("status") == "nodump", F.lit(False)))
    ids = _in_ancestors(items, chain, named).join(dumped.select("item_id"), "item_id", "left_semi")
    top = chain.join(named, (chain["cat_id"] == named["b_cat_id"]) & (chain["ancestor"] == named["b_name"]), "left_anti").groupBy("cat_id", "name").agg(F.max_by("ancestor", "depth").alias("top"))
    moved = items.join(ids, "item_id", "left_anti").join(top.withColumnRenamed("name", "set_name"), ["cat_id", "set_name"], "left")
    led = F.col("top").isNotNull() & F.lit(with_set_name) & ~F.coalesce("is_disk", F.lit(False))
    return moved.withColumn("item_name", F.when(led, F.concat_ws("/", "set_name", "name")).otherwise(F.col("name"))).withColumn("home", F.coalesce("top", "set_name")).drop("top")


def non_merge_sets(items: DataFrame, refs: DataFrame) -> DataFrame:
    """refs(cat_id, set_name, device): items of all devices reachable by reference join a set unless it has the same SHA1
    under the same name; of equal ones from several devices the least item joins. (cat_id, set_name, item_id, name, sha1);
    an unknown SHA1 equals none."""
    pulled = reachable(refs).join(items.select("cat_id", F.col("set_name").alias("device"), "item_id", "name", "sha1"), ["cat_id", "device"]).drop("device").distinct()
    once = pulled.where("sha1 is not null").groupBy("cat_id", "set_name", "name", "sha1").agg(F.min("item_id").alias("item_id"))
    new = once.join(items.select("cat_id", "set_name", "name", "sha1"), ["cat_id", "set_name", "name", "sha1"], "left_anti")
    return new.unionByName(pulled.where("sha1 is null")).select("cat_id", "set_name", "item_id", "name", "sha1")


def unneeded_dirs(items: DataFrame) -> DataFrame:
    """Drop 'x/' entries of size 0 that another name of the set extends. The equi-key are the names' parent prefixes."""
    parts = F.split("name", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    longer = items.where(F.size(parts) > 1).select("set_name", F.explode(prefixes).alias("dir"), "name").where("name <> dir").select("set_name", F.col("dir").alias("name")).distinct()
    empty = F.col("name").endswith("/") & (F.col("size") == 0)
    return items.join(longer.withColumn("extended", F.lit(True)), ["set_name", "name"], "left").where(~(empty & F.coalesce("extended", F.lit(False)))).drop("extended")


def expand_dirs(items: DataFrame) -> DataFrame:
    """Directory nodes for every level of 'a/b/c' names: (set_name, dir, depth)."""
    parts = F.split("name", "/")
    each = items.where(F.size(parts) > 1).select("set_name", parts.alias("parts"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("depth"))
    return each.select("set_name", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("dir"), "depth").distinct()


def auto_directory(name: Column, description: Column, root_dir: Column, file_name: Column, use_description: Column) -> Column:
    given = F.when(use_description, F.nullif(F.trim(description), F.lit("")))
    return F.coalesce(given, F.nullif(F.trim(root_dir), F.lit("")), F.nullif(F.trim(name), F.lit("")), file_name)


def files_as_sets(items: DataFrame) -> DataFrame:
    """Loose files become sets of their stem."""
    return items.withColumn("set_name", F.coalesce("set_name", stem(F.col("name"))))


def without_empty_sets(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Sets that have items, or a set below them (name/...) that does; sets(cat_id, name), items(cat_id, set_name)."""
    parts = F.split("set_name", "/")
    used = items.where("set_name is not null").select("cat_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("name")).distinct()
    return sets.join(used, ["cat_id", "name"], "left_semi")
