"""Approximate nearest neighbours by collision counting.

The largest inner product becomes the least distance: each vector x gets one component more, sqrt(M^2 - |x|^2), with M
the largest norm, and queries are scaled to length M. `PROJECTIONS` random lines are the hash functions; each block of
vectors holds its projections in one sorted array a line. A query opens a window around its own projection in every
array and widens all windows step by step (virtual rehashing: the wider window is the union of finer ones over the same
arrays). A vector that lies in at least `THRESHOLD` of the windows is verified by its true inner product;
a query stops in a block when `k` plus `VERIFIED` times the root of the block's size are verified.

Vectors are dealt into blocks of about `BLOCK` rows and queries into chunks of `CHUNK`; each (block, chunk) is a task of
its own, so neither side is gathered whole. Every block gives its best k for each query; k times the number of blocks
meet for the final ranks.

Defined cases: rows of null id, and vectors that are null, empty, zero or hold null or non-finite components, take no part, as queries or
candidates; vectors of another length than the query's are no candidates; ties go to the smaller id; rows with equal ids
are separate candidates unless their id is the query's own, and a query id is asked once; with k or fewer candidates all
are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import staged, table

PROJECTIONS, THRESHOLD, GROWTH, VERIFIED, PROBES = 96, 58, 1.12, 10, 32
BLOCK, CHUNK, SEED = 8192, 4096, 11


def usable(v: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def lines(dims: int, m: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((m, dims + 1))


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, largest: float) -> list[tuple[int, int, float]]:
    """(query, id, inner product): each query's best k of one block."""
    n, dims = x.shape
    a = lines(dims)
    m = len(a)
    extra = np.sqrt(np.maximum(largest**2 - np.einsum("ij,ij->i", x, x), 0))
    px = x @ a[:, :dims].T + extra[:, None] * a[:, dims]
    pq = (q * (largest / np.linalg.norm(q, axis=1))[:, None]) @ a[:, :dims].T
    order = np.argsort(px, axis=0, kind="stable").T
    ranked = np.take_along_axis(px.T, order, 1)
    place = np.empty((m, n), np.uint16 if n < 1 << 16 else np.uint32)  # of each vector in each sorted array
    np.put_along_axis(place, order, np.arange(n, dtype=place.dtype)[None, :], 1)
    enough = min(n, k + 1 + int(VERIFIED * math.sqrt(n)))
    widest = float(np.ptp(px)) + 2 * float(np.abs(pq).max(initial=0)) + 1
    half = np.full(len(q), 0.55 * float(px.std() or 1.0))
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
    _count(np.arange(min(PROBES, len(q))), found, half, pq, ranked, place, enough, widest)
    half[PROBES:] = np.median(half[:PROBES]) / GROWTH if len(q) else 0  # the others start near where the first ones ended
    _count(np.arange(PROBES, len(q)), found, half, pq, ranked, place, enough, widest)
    out = []
    for i, (v, own) in enumerate(zip(q, q_ids.tolist(), strict=True)):
        near = found[i][ids[found[i]] != own]
        s = x[near] @ v
        best = np.lexsort((ids[near], -s))[:k]
        out += [(own, int(ids[near[b]]), float(s[b])) for b in best]
    return out


def _count(active, found, half, pq, ranked, place, enough, widest) -> None:
    """Widen the windows of the active queries until each has enough vectors that collide often; `half` ends at their widths."""
    m = len(ranked)
    while len(active):
        low = np.stack([np.searchsorted(ranked[j], pq[active, j] - half[active]) for j in range(m)], 1).astype(place.dtype)
        high = np.stack([np.searchsorted(ranked[j], pq[active, j] + half[active], "right") for j in range(m)], 1).astype(place.dtype)
        left = []
        for i, lo, hi in zip(active.tolist(), low, high, strict=True):
            inside = (place - lo[:, None]) < (hi - lo)[:, None]  # unsigned: places before the window wrap round
            found[i] = np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint16) >= THRESHOLD)
            if len(found[i]) < enough and half[i] <= widest:
                left.append(i)
        active = np.array(left, np.int64)
        half[active] *= GROWTH


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product found for every query row."""
    to = F.col(vec_col).cast("array<double>")
    valid = lambda df: df.select(F.col(id_col).cast("long").alias("id"), to.alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows, asked = staged(valid(vectors)), staged(valid(queries).dropDuplicates(["id"]))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    sizes = rows.agg(F.count("*").alias("n"), F.max(norm).alias("most")).first()
    blocks, chunks = max(1, -(-sizes["n"] // BLOCK)), max(1, -(-asked.count() // CHUNK))
    largest = float(sizes["most"] or 1.0)
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n)).cast("int")
    left = rows.select("id", "v", F.size("v").alias("dims"), dealt(blocks).alias("block"), F.explode(number(chunks)).alias("chunk"))
    right = asked.select("id", "v", F.size("v").alias("dims"), dealt(chunks).alias("chunk"), F.explode(number(blocks)).alias("block"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        dense = lambda t: np.stack(t.column("v").to_numpy()) if t.num_rows else None
        found = []
        if a.num_rows and b.num_rows:
            x, ids, qs, q_ids = dense(a), a.column("id").to_numpy(), dense(b), b.column("id").to_numpy()
            for s in range(0, len(qs), 512):
                found += search(x, ids, qs[s : s + 512], q_ids[s : s + 512], k, largest)
        at = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(at[0], pa.int64()), "vec_id": pa.array(at[1], pa.int64()), "score": pa.array(at[2], pa.float64())})

    keys = ["dims", "block", "chunk"]
    each = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


QUERIES = {"op9_collision_neighbours": op9_collision_neighbours}
