"""Connected components of a distributed edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm._shared import discard, materialise


SALTS = 64


def _with_least(edges: DataFrame) -> DataFrame:
    """edges(u, v) with m, the least v of each u. Neighbours of a node are dealt to SALTS places by their hash: minima are
    taken per place and then per node (SALTS rows at most), and go back to the places that have rows. So no task gets
    more than its share of a hub's edges, at any size."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    by_place = dealt.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = by_place.groupBy("u").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))
    return dealt.join(least.select("u", "m", F.explode("salts").alias("salt")).hint("merge"), ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u moves to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).select("u", "v", F.least("m", "u").alias("m")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u (above its neighbours) and its neighbours move to the least of these."""
    found = _with_least(edges)
    return found.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).selectExpr("x.v u", "x.m v").where("u <> v")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.min("u"), F.max("v")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: two long columns, in any direction, repeats and loops allowed. Returns (node, component): every node that
    has an edge to another one, and the least node it can reach. Work and memory stay distributed; a round is one
    written table, about log2 of the longest chain of them."""
    a, b = (F.col(c) for c in edges.columns)
    now = materialise(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(now)
    while True:
        after = materialise(_small_star(_large_star(now)).distinct())
        was, state = state, _state(after)
        discard(now)
        now = after
        if state == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
