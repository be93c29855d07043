"""Exact top-k inner products by columnar branch and bound.

Vectors are quantised to whole numbers, floor(scale * x). The candidates are dealt to blocks of rows, the queries to
blocks as well, and each pair of blocks is one task's work, so a task's memory depends on the block sizes alone and the
work is spread over as many tasks as there are pairs. Blocks of candidates come in rounds, `growth` of them first and
then `growth` times as many as came so far. After a round each query's k best are a written table, and the k-th score is
the threshold with which the query enters the next round: a block returns only candidates that reach it. So the rows
that blocks return grow with the number of rounds, the logarithm of the number of blocks.

In a task, candidates lie in vertical layout: one row a dimension, dimensions of greatest mass first, in blocks. For a
block of queries, the first dimension block gives partial products of all candidates at once. By the Cauchy-Schwarz
inequality the rest adds at most |rest of query| * |rest of candidate|; the remaining masses are suffix sums of squares.
The exact scores of the k most promising candidates give a threshold, if the one brought along is not higher; per query,
candidates whose bound lies below it are dropped, the survivors are compacted, the next dimension block is added for them alone, and so on. Bounds are kept
above their true values, and equal scores are never dropped, so the result is exact. A last merge keeps each query's k
best over all blocks.

Ties go to the smaller vec_id. Vectors that are null or hold a null or non-finite component take no part; a query meets
vectors of its own dimension only. Rows with a null vec_id take no part. A query is a vec_id divisible by
`query_modulus`; rows of the same vec_id are the query's own and are not its candidates, and of repeated query rows the
least vector asks. Products are exact while sums stay below 2^53 (components below 2^23 at up to 128 dimensions);
larger ones are worked in 64-bit whole numbers. Empty table: no rows. Only vec_id and the vector are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm._shared import materialise

_EXACT = 2.0**52


def quantised(table: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    fits = "embedding is not null and vec_id is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(fits).selectExpr("vec_id", f"transform(embedding, x -> cast(floor(x * {scale}) as long)) v")


def _matrix(column: pa.ChunkedArray, rows: np.ndarray, dims: int) -> np.ndarray:
    values = column.combine_chunks()
    flat, at = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
    return flat[at[rows][:, None] + np.arange(dims)]


def _lengths(column: pa.ChunkedArray) -> np.ndarray:
    return np.diff(column.combine_chunks().offsets.to_numpy())


def search_block(q_id: np.ndarray, queries: np.ndarray, c_id: np.ndarray, cands: np.ndarray, k: int, dim_block: int, query_block: int, least: np.ndarray | None = None) -> list[tuple]:
    """(query_id, vec_id, score) of each query's k best candidates; both matrices hold a vector a row. `least` are scores
    that a query's candidates must reach; without it all may be returned."""
    least = np.full(len(q_id), np.iinfo(np.int64).min) if least is None else least
    dims = queries.shape[1]
    peak = float(np.abs(queries).max(initial=0)) * float(np.abs(cands).max(initial=0)) * max(1, dims)
    kind = np.float64 if peak < _EXACT else np.int64
    mass = (cands.astype(np.float64) ** 2).sum(axis=0)
    order = np.argsort(-mass, kind="stable")
    by_id = np.argsort(c_id, kind="stable")  # candidates in order of vec_id: ties resolve by place
    c_id = c_id[by_id]
    vertical = np.ascontiguousarray(cands[by_id][:, order].T.astype(kind))
    cuts = [*range(0, dims, dim_block), dims] if dims else [0]
    c_rest = [np.sqrt((vertical[a:].astype(np.float64) ** 2).sum(axis=0)) for a in cuts]
    out = []
    for i in range(0, len(queries), query_block):
        ids, floors, block = q_id[i : i + query_block], least[i : i + query_block], queries[i : i + query_block][:, order].astype(kind)
        first = block[:, : cuts[1]] @ vertical[: cuts[1]] if dims else np.zeros((len(block), len(c_id)), kind)
        for row, (qid, floor, query) in enumerate(zip(ids, floors, block, strict=True)):
            q_rest = [math.sqrt(float((query[a:].astype(np.float64) ** 2).sum())) * (1 + 1e-9) for a in cuts]
            alive = np.flatnonzero(c_id != qid)
            partial = first[row][alive]
            if len(alive) > k and dims:
                promise = partial + q_rest[1] * c_rest[1][alive]
                best = alive[np.argpartition(promise, -k)[-k:]]
                threshold = max((query @ vertical[:, best]).min(), floor)
                for step in range(1, len(cuts)):
                    rounding = 1e-12 * (np.abs(partial) + abs(float(threshold))) + 1e-6
                    keep = partial + (q_rest[step] * c_rest[step][alive] * (1 + 1e-9) + rounding) >= threshold
                    alive, partial = alive[keep], partial[keep]
                    if step + 1 < len(cuts):
                        a, b = cuts[step], cuts[step + 1]
                        partial = partial + query[a:b] @ vertical[a:b, alive]
            elif dims:
                partial = query @ vertical[:, alive]
            top = np.lexsort((alive, -partial))[:k]
            top = top[partial[top] >= floor]
            out += [(int(qid), int(c), int(s)) for c, s in zip(c_id[alive[top]], partial[top], strict=True)]
    return out


def top_k(table: DataFrame, k: int = 20, query_modulus: int = 20, scale: int = 64, cand_block: int = 16384, query_rows: int = 8192, dim_block: int = 16, growth: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score)."""
    own = quantised(table, scale)
    found = own.agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % query_modulus == 0, 1)).alias("q")).first()
    blocks, q_blocks = max(1, -(-found["n"] // cand_block)), max(1, -(-found["q"] // query_rows))
    spread = F.xxhash64("vec_id", "v")
    every = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high - 1)))
    dealt = own.select("vec_id", "v", F.pmod(spread, F.lit(blocks)).cast("int").alias("c"))
    asking = own.where(F.col("vec_id") % query_modulus == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asking = materialise(asking.select("vec_id", "v", F.pmod(spread, F.lit(q_blocks)).cast("int").alias("q")))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            (q_n, c_n), (q_all, c_all) = (_lengths(x["v"]) for x in (left, right)), (x["vec_id"].to_numpy() for x in (left, right))
            least = left["least"].to_numpy()
            for dims in np.unique(q_n):
                of, among = np.flatnonzero(q_n == dims), np.flatnonzero(c_n == dims)
                if len(among):
                    rows += search_block(q_all[of], _matrix(left["v"], of, dims), c_all[among], _matrix(right["v"], among, dims), k, dim_block, 256, least[of])
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    best, low, high = None, 0, min(blocks, growth)
    lowest = F.lit(-(1 << 63)).cast("long")
    while True:
        if best is None:
            with_least = asking.withColumn("least", lowest)
        else:
            kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
            with_least = asking.join(kth, "vec_id", "left").withColumn("least", F.coalesce("least", lowest))
        queries = with_least.select("vec_id", "v", "least", every(low, high).alias("c"), "q")
        cands = dealt.where((F.col("c") >= low) & (F.col("c") < high)).select("vec_id", "v", "c", every(0, q_blocks).alias("q"))
        met = queries.groupBy("c", "q").cogroup(cands.groupBy("c", "q")).applyInArrow(work, "query_id long, vec_id long, score long")
        both = met if best is None else best.select(met.columns).union(met)
        ranked = both.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if high == blocks:
            return ranked
        best, low, high = materialise(ranked), high, min(blocks, high * growth)
