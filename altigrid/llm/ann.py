"""Approximate nearest neighbours by collision counting.

Every vector is projected on ``PROJECTIONS`` single lines. The index is a table of blocks; a block
holds its vectors and one sorted array per line. A query block meets every vector block (a stated query
set against all rows): windows of half-width ``w * R`` around each query's projections are read from the
sorted arrays, and the radius R grows by a factor (virtual rehashing: no array is rebuilt) until enough
vectors have collided on more than the threshold's share of lines and the k-th verified one lies within
reach of the radius. Only those vectors are compared exactly, in double precision; the last step keeps
the k nearest over all blocks.

Each block runs the whole search over its rows, so a block's k nearest are all that later steps see:
k rows per query and block, whatever the block holds.

Defined results: vectors that are null, zero, empty, or hold a null or non-finite component take no
part, nor do null ids. Rows of another dimension are never candidates of a query. Repeated ids are rows
of their own, but a query's own id is no candidate. Equal distances go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from altigrid.model import cut

PROJECTIONS = 48
SHARE = 0.62
GROWTH = 1.5
BLOCK_ROWS = 4096
QUERY_ROWS = 256


def usable(vector: str) -> Column:
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def lines(dim: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, PROJECTIONS))


def blocks(vectors: DataFrame, per_block: int) -> DataFrame:
    """(dim, block, ids, data, order): vectors dealt evenly to blocks, each with its sorted arrays."""
    n = vectors.count()
    count = max(1, math.ceil(n / per_block))
    dealt = vectors.select(
        F.col("id"), F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int").alias("block"), F.col("v").cast("array<double>").alias("v"))
    # repeated rows would share a hash: a row number within the task breaks them up
    dealt = dealt.withColumn("block", F.pmod(F.col("block") + F.monotonically_increasing_id(), F.lit(count)).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        order = np.argsort(x @ lines(dim), axis=0, kind="stable").astype(np.int32)
        return pa.table({"dim": t["dim"][:1], "block": t["block"][:1], "ids": pa.array([t["id"].to_numpy().tobytes()], pa.binary()),
                         "data": pa.array([x.tobytes()], pa.binary()), "order": pa.array([order.T.tobytes()], pa.binary())})

    return dealt.groupBy("dim", "block").applyInArrow(build, "dim int, block int, ids binary, data binary, order binary")


def search(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, distance) of the k nearest found in one block. Queries share the rounds."""
    a = lines(x.shape[1])
    px, pq = x @ a, q @ a
    n, m = len(x), a.shape[1]
    arrays = [px[order[j], j] for j in range(m)]
    need = math.ceil(SHARE * m)
    radius = 0.5 * (float(np.median(np.std(px, axis=0))) or 1.0)
    counts = np.zeros((len(q), n), np.int16)
    lo = np.stack([np.searchsorted(s, pq[:, j]) for j, s in enumerate(arrays)], 1)
    hi = lo.copy()
    seen = ids[None, :] == qid[:, None]
    want = np.minimum(k, n - seen.sum(axis=1))
    found = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
    active = np.flatnonzero(want > 0)
    while len(active):
        for j, s in enumerate(arrays):
            left = np.minimum(np.searchsorted(s, pq[active, j] - radius, side="left"), lo[active, j])
            right = np.maximum(np.searchsorted(s, pq[active, j] + radius, side="right"), hi[active, j])
            for i, b, c, d, e in zip(active.tolist(), left.tolist(), lo[active, j].tolist(), hi[active, j].tolist(), right.tolist(), strict=True):
                if b < c:
                    counts[i][order[j, b:c]] += 1
                if d < e:
                    counts[i][order[j, d:e]] += 1
            lo[active, j], hi[active, j] = left, right
        still = []
        for i in active.tolist():
            fresh = np.flatnonzero((counts[i] >= need) & ~seen[i])
            row, dist = found[i]
            if len(fresh):
                seen[i, fresh] = True
                d = x[fresh] - q[i]
                row, dist = np.concatenate([row, fresh]), np.concatenate([dist, np.sqrt((d * d).sum(axis=1))])
                if len(dist) > want[i]:
                    keep = np.lexsort((ids[row], dist))[: want[i]]
                    row, dist = row[keep], dist[keep]
                found[i] = (row, dist)
            # a vector at distance d projects within d of the query on two lines in three
            near = len(dist) == want[i] and dist.max() <= radius * 1.02
            if not near and not ((lo[i] == 0).all() and (hi[i] == n).all()):
                still.append(i)
        active = np.array(still, np.int64)
        radius *= GROWTH
    rows = np.repeat(np.arange(len(q)), [len(r) for r, _ in found])
    return rows, np.concatenate([r for r, _ in found] or [np.zeros(0, np.int64)]), np.concatenate([d for _, d in found] or [np.zeros(0)])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding",
            per_block: int = BLOCK_ROWS, per_query_block: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query row, nearest first."""
    rows = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & usable("v"))
    index = cut(blocks(rows(vectors), per_block))
    asked = rows(queries)
    parts = max(1, math.ceil(asked.count() / per_query_block))
    packed = asked.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("q"), "id", F.col("v").cast("array<double>").alias("v"))
    packed = packed.groupBy("dim", "q").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("qs"))
    # every query block meets every vector block of its dimension
    places = index.select(F.col("dim").alias("_d"), F.col("block").alias("_b"))
    pairs = packed.join(places, F.col("dim") == F.col("_d")).drop("dim")

    def run(ask: pa.Table, have: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if have.num_rows and ask.num_rows:
            dim = have["dim"][0].as_py()
            ids = np.frombuffer(have["ids"][0].as_py(), np.int64)
            x = np.frombuffer(have["data"][0].as_py(), np.float64).reshape(-1, dim)
            order = np.frombuffer(have["order"][0].as_py(), np.int32).reshape(-1, len(x))
            for qs in ask["qs"].to_pylist():
                qid = np.array([r["id"] for r in qs], np.int64)
                r, c, d = search(np.array([r["v"] for r in qs]), qid, x, ids, order, k)
                out["query_id"].append(qid[r])
                out["vec_id"].append(ids[c])
                out["score"].append(d)
        cat = lambda z, kind: np.concatenate(z) if z else np.zeros(0, kind)
        return pa.table({"query_id": cat(out["query_id"], np.int64), "vec_id": cat(out["vec_id"], np.int64), "score": cat(out["score"], np.float64)})

    found = pairs.groupBy("_d", "_b").cogroup(index.groupBy("dim", "block")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    near = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
