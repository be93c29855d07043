"""Merges of catalogs and scans into the state, and attributes inherited along paths."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.scalars import agrees, tested
from ledgerlark.sources.scratch import written

_HASHES = ["crc", "sha1", "md5"]


def hashes_match(a: str, b: str) -> Column:
    """All known hashes agree and one at least was tested; size 0 on both sides is enough where none is known."""
    pairs = [(F.col(f"{a}{h}"), F.col(f"{b}{h}")) for h in _HASHES]
    agree, seen = agrees(F.col(f"{a}size"), F.col(f"{b}size")), F.lit(False)
    for x, y in pairs:
        agree, seen = agree & agrees(x, y), seen | tested(x, y)
    return agree & (seen | ((F.col(f"{a}size") == 0) & (F.col(f"{b}size") == 0)))


_SIDES = "state_id long, incoming_id long"


def _pair(group: pd.DataFrame, hash_needed: bool) -> pd.DataFrame:
    """Pairs of one folded name, greedily: exact names first, then by ids. Rows of one name and hash profile wait in one
    queue, so a row is compared with profiles and not with copies."""
    known = ["size", *_HASHES]
    rows = group.astype(object).where(group.notna(), None).sort_values("node_id").to_dict("records")
    queues: dict[tuple, deque] = {}
    for r in rows:
        if not r["old"]:
            queues.setdefault((r["name"], *(r[k] for k in known)), deque()).append(r["node_id"])

    def fits(x: tuple, y: tuple) -> bool:
        both = [a == b for a, b in zip(x, y, strict=True) if a is not None and b is not None]
        tested = any(a is not None and a == b for a, b in zip(x[1:], y[1:], strict=True))
        return not hash_needed or (all(both) and (tested or x[0] == y[0] == "0"))

    left, out = [r for r in rows if r["old"]], []
    for exact in (True, False):
        rest = []
        for r in left:
            own = tuple(r[k] for k in known)
            found = [(q[0], k) for k, q in queues.items() if (k[0] == r["name"]) == exact and fits(own, k[1:])]
            if not found:
                rest.append(r)
                continue
            first, k = min(found, key=lambda f: f[0])
            out.append((r["node_id"], first))
            queues[k].popleft()
            if not queues[k]:
                del queues[k]
        left = rest
    return pd.DataFrame(out, columns=["state_id", "incoming_id"]).astype("int64")


def merge(state: DataFrame, incoming: DataFrame, hash_needed: bool = True) -> DataFrame:
    """Full outer merge by (parent, type, name): exact names first, then names equal but for case; one to one, the first
    unmatched wins. Both sides: (node_id, parent, file_type, name, size, crc, sha1, md5). Returns (state_id, incoming_id,
    outcome). Names with one row a side are a join; names with more are paired one by one until no pair is left."""
    key = ["parent", "file_type", "folded"]
    cols = ["node_id", "parent", "file_type", "name", F.col("size").cast("string").alias("size"), *_HASHES, F.lower("name").alias("folded")]
    rows = state.select(*cols, F.lit(True).alias("old")).unionByName(incoming.select(*cols, F.lit(False).alias("old"))).dropna(subset=key)
    counts = rows.groupBy(*key).agg(F.count_if("old").alias("n_old"), F.count_if(~F.col("old")).alias("n_new")).where("n_old > 0 and n_new > 0")
    marked = written(rows.join(counts, key))
    many, one = marked.where("n_old > 1 or n_new > 1").select(*rows.columns), marked.where("n_old = 1 and n_new = 1")
    side = lambda old, mark: one.where(F.col("old") == old).select(*key, *(F.col(c).alias(f"{mark}{c}") for c in ["node_id", "size", *_HASHES]))
    single = side(True, "s_").join(side(False, "i_"), key).where(hashes_match("s_", "i_") if hash_needed else F.lit(True))
    paired = many.groupBy(*key).applyInPandas(lambda g: _pair(g, hash_needed), _SIDES)
    taken = written(single.select(F.col("s_node_id").cast("long").alias("state_id"), F.col("i_node_id").cast("long").alias("incoming_id")).unionByName(paired))
    old = state.select(F.col("node_id").alias("state_id")).join(taken, "state_id", "left_anti").selectExpr("state_id", "cast(null as long) incoming_id", "'gone' outcome")
    new = incoming.select(F.col("node_id").alias("incoming_id")).join(taken, "incoming_id", "left_anti").selectExpr("cast(null as long) state_id", "incoming_id", "'new' outcome")
    return taken.withColumn("outcome", F.lit("same")).unionByName(old).unionByName(new)


def catalog_diff(before: DataFrame, now: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keep, new or delete for every catalog; one whose values changed is deleted and new."""
    cols = [*keys, *values]
    a, b = before.select(*cols).distinct().withColumn("old", F.lit(1)), now.select(*cols).distinct().withColumn("new", F.lit(1))
    return a.join(b, cols, "full").withColumn("outcome", F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "delete").otherwise("keep")).select(*cols, "outcome")


def _prefixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def longest_prefix(paths: DataFrame, rules: DataFrame, value: str, last_wins: bool = True) -> DataFrame:
    """paths(path) with the value of the rule whose dir_key is the longest leading part of the path; ties go to the last
    rule (or the first). rules(dir_key, ord, value)."""
    key = F.struct(F.length("dir_key"), F.col("ord") if last_wins else -F.col("ord"))
    hits = paths.select("path").distinct().select("path", F.explode(_prefixes(F.col("path"))).alias("dir_key")).join(rules, "dir_key")
    best = hits.groupBy("path").agg(F.max_by(value, key).alias(value), F.max_by("dir_key", key).alias("dir_key"))
    return paths.join(best, "path", "left")


def map_directory(paths: DataFrame, mappings: DataFrame) -> DataFrame:
    """paths with `mapped`: the mapping's directory and the rest of the path; unmapped paths stay."""
    found = longest_prefix(paths, mappings, "dir_path", last_wins=False)
    return found.withColumn("mapped", F.when(F.col("dir_path").isNotNull(), F.concat("dir_path", F.substring("path", F.length("dir_key") + 1, F.length("path")))).otherwise(F.col("path"))).select("path", "mapped")


def inherit(nodes: DataFrame, marks: DataFrame, value: str, default: str) -> DataFrame:
    """nodes(path) with the value of the nearest ancestor (or the node itself) that has one."""
    found = longest_prefix(nodes, marks.select(F.col("path").alias("dir_key"), F.lit(0).alias("ord"), value), value)
    return found.withColumn(value, F.coalesce(value, F.lit(default))).drop("dir_key")


def lost(nodes: DataFrame) -> DataFrame:
    """What a scan no longer finds: rows outside catalogs go, the others lose what only the file said and become missing.
    Alternates that a catalog gave (alt_*_from_dat) become the primary attributes; alternates then are unknown."""
    kept = nodes.where("dat_status not in ('NotInDat', 'InToSort')")
    out = {}
    for h in ("size", *_HASHES):
        own = F.when(F.col(f"{h}_from_dat"), F.col(h))
        out[h] = F.when(F.coalesce(f"alt_{h}_from_dat", F.lit(False)), F.col(f"alt_{h}")).otherwise(own) if f"alt_{h}_from_dat" in kept.columns else own
        if f"alt_{h}_from_dat" in kept.columns:
            out |= {f"{h}_from_dat": F.col(f"{h}_from_dat") | F.coalesce(f"alt_{h}_from_dat", F.lit(False)), f"alt_{h}": F.lit(None).cast(dict(kept.dtypes)[f"alt_{h}"]), f"alt_{h}_from_dat": F.lit(False)}
    return kept.withColumns(out | {"got_status": F.lit("NotGot")})


def merge_members(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """An archive's members: every incoming member that matches a known one of its name (hashes agree, one tested) merges
    into it, several into one too; the first known one by node_id takes it. (state_id, incoming_id, outcome) as merge()."""
    cols = ["parent", "file_type", "name"]
    side = lambda df, mark: df.select(*cols, *(F.col(c).alias(f"{mark}{c}") for c in ["node_id", "size", *_HASHES]))
    # copies of one profile are one row on the known side, so a repeated name costs profiles and not pairs
    known = side(state, "s_").groupBy(*cols, *(f"s_{c}" for c in ["size", *_HASHES])).agg(F.min("s_node_id").alias("s_node_id"))
    hits = side(incoming, "i_").join(known, cols).where(hashes_match("s_", "i_"))
    taken = hits.groupBy(F.col("i_node_id").alias("incoming_id")).agg(F.min("s_node_id").alias("state_id")).select("state_id", "incoming_id")
    old = state.select(F.col("node_id").alias("state_id")).join(taken, "state_id", "left_anti").selectExpr("state_id", "cast(null as long) incoming_id", "'gone' outcome")
    new = incoming.select(F.col("node_id").alias("incoming_id")).join(taken, "incoming_id", "left_anti").selectExpr("cast(null as long) state_id", "incoming_id", "'new' outcome")
    return taken.withColumn("outcome", F.lit("same")).unionByName(old).unionByName(new)


def merge_by_time(state: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first phase of a scan, before anything is hashed: files of a known path, name and type whose time and size are
    the known ones are the known files: (state_id, incoming_id). The second result are the rows still to be hashed and
    merged by merge(). Both sides: (node_id, parent, file_type, name, mtime, size)."""
    at = ["parent", "file_type", "name", "mtime", "size"]
    once = lambda df, name: df.dropna(subset=at).groupBy(*at).agg(F.min("node_id").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    pairs = once(state, "state_id").join(once(incoming, "incoming_id"), at).select("state_id", "incoming_id")
    return pairs, incoming.join(pairs, incoming["node_id"] == pairs["incoming_id"], "left_anti")


def unchanged(files: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to scan, files that path and time show to be known)."""
    return files.join(known, ["path", "mtime"], "left_anti"), files.join(known, ["path", "mtime"], "left_semi")


def save_state(nodes: DataFrame, root: str, version: int) -> None:
    """Write the state as a version of its own below root, partitioned by root_kind; a reader sees it only once complete,
    and the version before stays as its backup."""
    nodes.write.mode("errorifexists").partitionBy("root_kind").parquet(f"{root}/v={version}")


def load_state(spark: SparkSession, root: str, schema: str | None = None) -> tuple[DataFrame, int]:
    """(state, version): the newest complete version below root."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [int(x.getPath().getName()[2:]) for x in fs.listStatus(path) if x.getPath().getName().startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    if not found:
        raise FileNotFoundError(f"no complete state below {root}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{root}/v={max(found)}"), max(found)
