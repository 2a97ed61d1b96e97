"""Exact nearest-neighbour joins in blocks, and what is built from them.

Both sides are dealt into blocks (see `blocks`) by a hash of the id; a pair of blocks is one task's work, so no group, however
large, meets in one task. Where both sides are one table, a task takes a pair of blocks both ways, so that a row is sent once
a block and not twice. Within a pair of blocks numpy finds each left row's best k, in tiles; a window over k rows
a block gives the final ranks. The work is that of an exact join; nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.stage import stored

#: A block of this many rows is worth a task; at most GRID such blocks are made until they have LARGE rows each.
BLOCK, GRID, LARGE = 4096, 6, 65_536
#: The same where both sides are one table: blocks of half as many rows are worth a task, which takes two ways.
BOTH_WAYS = 2
#: Rows and columns of a tile of distances, numbers held for its rows, and pairs compared at a time.
TILE, HELD, COMPARED = (512, 2048), 2_000_000, 100_000


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two blocks, from inner products."""
    g = x @ y.T
    if metric == "cosine":
        return 1 - g / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None])
    if metric == "euclidean":
        return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * g))
    raise ValueError(f"unknown metric: {metric}")


def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of two blocks; those that cancellation would spoil are taken term by term."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
    d = square - 2 * (x @ y.T)
    rows, cols = np.nonzero(~(d > 1e-4 * square))
    d = np.sqrt(np.maximum(0, d))
    for s in range(0, len(rows), COMPARED):
        d[rows[s : s + COMPARED], cols[s : s + COMPARED]] = exact(x[rows[s : s + COMPARED]], y[cols[s : s + COMPARED]], "euclidean")
    return d


def exact(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of row pairs, term by term (no cancellation)."""
    if metric == "cosine":
        return 1 - (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    return np.sqrt(((x - y) ** 2).sum(1))


def _same(ids: np.ndarray, jds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of equal ids, by row."""
    order = np.argsort(jds, kind="stable")
    first, last = (np.searchsorted(jds[order], ids, side) for side in ("left", "right"))
    rows = np.repeat(np.arange(len(ids)), last - first)
    return rows, order[np.arange(len(rows)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[rows]]


def _least(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, y: np.ndarray, jds: np.ndarray, k: int, metric: str):
    """(row, column, distance) of the k nearest of each row's columns by exact distances, ties to the smaller j."""
    e = np.concatenate([exact(x[rows[s : s + COMPARED]], y[cols[s : s + COMPARED]], metric) for s in range(0, len(rows), COMPARED)] or [np.empty(0)])
    order = np.lexsort((jds[cols], e, rows))
    rows, cols, e = rows[order], cols[order], e[order]
    own = (np.arange(len(rows)) - np.searchsorted(rows, rows) < k) & np.isfinite(e)
    return rows[own], cols[own], e[own]


def best(x: np.ndarray, ids: np.ndarray, y: np.ndarray, jds: np.ndarray, k: int, metric: str, self_too: bool, closed: tuple[np.ndarray, np.ndarray] | None = None):
    """(i, j, d) of the k nearest in y for each row of x, ties to the smaller j; rows and columns of one `closed` mark do not meet.

    Both sides are taken in tiles of at most TILE. A row keeps the k least of the tiles so far, so that later tiles are only
    compared with its k-th. All columns that rounding may have moved across that are compared by exact distances, however
    many.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric: {metric}")
    unit = 4 * (x.shape[1] + 8) * np.finfo(np.float64).eps
    tall, wide = max(1, min(TILE[0], HELD // max(1, 4 * k))), TILE[1]
    with np.errstate(all="ignore"):
        xs, ys = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y)) if metric == "cosine" else (x, y)
        square = np.zeros(len(y)) if metric == "cosine" else (y * y).sum(1)
        finite = np.isfinite(square)
        largest = 1.0 if metric == "cosine" else square[finite].max(initial=0.0)
        plain = finite.all() and np.isfinite(xs).all() and np.isfinite(ys).all()
        own = _same(ids, jds) if not self_too else None
        out = []
        for s in range(0, len(x), tall):
            part = xs[s : s + tall]
            n = len(part)
            slack = 4 * unit * ((part * part).sum(1) + largest)
            least, limit = np.empty((n, 0)), np.full(n, np.inf)
            rows, cols, pending = np.empty(0, np.int64), np.empty(0, np.int64), 0
            if own is not None:
                mine = slice(*np.searchsorted(own[0], (s, s + n)))
                at, skip = own[0][mine] - s, own[1][mine]
            for t in range(0, len(y), wide):
                value = part @ ys[t : t + wide].T  # the distance squared, less what is the same in the whole row
                value *= -2
                value += square[None, t : t + wide]
                if own is not None:
                    here = (skip >= t) & (skip < t + wide)
                    value[at[here], skip[here] - t] = np.inf
                if closed is not None:
                    value[closed[0][s : s + n, None] == closed[1][None, t : t + wide]] = np.inf
                if not plain:
                    value[~np.isfinite(value)] = np.inf
                if least.shape[1] < k:
                    m = min(k, value.shape[1])
                    now = np.partition(value, m - 1, axis=1)[:, :m] if m < value.shape[1] else value
                    least = np.concatenate([least, now], 1)
                    if least.shape[1] > k:
                        least = np.partition(least, k - 1, axis=1)[:, :k]
                    if least.shape[1] == k:
                        limit = least.max(1) + slack
                    r, c = np.nonzero(value <= limit[:, None]) if np.isfinite(limit).all() else np.nonzero((value <= limit[:, None]) & np.isfinite(value))
                else:
                    r, c = np.nonzero((value <= limit[:, None]) & np.isfinite(value)) if not np.isfinite(limit).all() else np.nonzero(value <= limit[:, None])
                    if len(r):
                        place = np.arange(len(r)) - np.searchsorted(r, r)
                        few = place < k  # any k of a row's new columns give a true bound
                        more = np.full((n, int(place[few].max()) + 1), np.inf)
                        more[r[few], place[few]] = value[r[few], c[few]]
                        least = np.partition(np.concatenate([least, more], 1), k - 1, axis=1)[:, :k]
                        limit = least.max(1) + slack
                rows, cols = np.concatenate([rows, r]), np.concatenate([cols, c + t])
                if len(rows) - pending > HELD:
                    rows, cols, _ = _least(rows, cols, x[s : s + n], y, jds, k, metric)
                    pending = len(rows)
            rows, cols, e = _least(rows, cols, x[s : s + n], y, jds, k, metric)
            out.append((ids[s + rows], jds[cols], e))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (ids[:0], jds[:0], np.empty(0))


def blocks(n: int, least: int | None = None) -> int:
    """Blocks of a side of n rows: none of more than about LARGE rows, at least GRID where there are so many of BLOCK rows.

    Every row is sent to each block of the other side, so what is shuffled grows with the blocks: GRID of them, until they
    are LARGE.
    """
    return max(1, min(-(-int(n or 0) // (least or BLOCK)), max(GRID, -(-int(n or 0) // max(LARGE, least or BLOCK)))))


def knn(left: DataFrame, right: DataFrame, k: int, metric: str = "euclidean", by: tuple[str, ...] = (), self_too: bool = False) -> DataFrame:
    """i, j, d, rank (and the `by` columns of both sides, equal): the k nearest right rows of each left row.

    Both sides have cell_id and vec; rows meet where the `by` columns are equal.
    """
    w = Window.partitionBy("i", *by).orderBy("d", "j")
    if left is right:
        return _own_knn(left, k, metric, by, self_too).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    sides = [df.select(F.col("cell_id").alias("id"), F.col("vec").alias("v"), *[F.col(c).alias(c) for c in by]) for df in (left, right)]
    counts = [s.groupBy(*by).count().agg(F.max("count")).first()[0] or 0 for s in sides]
    na, nb = (blocks(c) for c in counts)
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = sides[0].withColumn("p", dealt(na)).withColumn("q", every(nb))
    b = sides[1].withColumn("q", dealt(nb)).withColumn("p", every(na))
    kinds = {c: left.schema[c].dataType.simpleString() for c in by}
    schema = "i long, j long, d double" + "".join(f", {c} {t}" for c, t in kinds.items())

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        i, j, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if x.num_rows and y.num_rows:
            vx, vy = (np.stack(t.column("v").to_numpy()) for t in (x, y))
            i, j, d = best(vx, x.column("id").to_numpy(), vy, y.column("id").to_numpy(), k, metric, self_too)
        out = {"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "d": pa.array(d, pa.float64())}
        for c in by:
            t = x if x.num_rows else y
            out[c] = pa.array([t.column(c)[0].as_py()] * len(i), t.schema.field(c).type)
        return pa.table(out)

    keys = [*by, "p", "q"]
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, schema)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _own_knn(cells: DataFrame, k: int, metric: str, by: tuple[str, ...], self_too: bool) -> DataFrame:
    """i, j, d and the `by` columns: the k nearest of each row in every block of its own table."""
    side = cells.select(F.col("cell_id").alias("id"), F.col("vec").alias("v"), *[F.col(c).alias(c) for c in by])
    n = blocks(side.groupBy(*by).count().agg(F.max("count")).first()[0] or 0, BLOCK // BOTH_WAYS)
    placed = side.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    placed = placed.select("id", "v", *by, "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    schema = "i long, j long, d double" + "".join(f", {c} {cells.schema[c].dataType.simpleString()}" for c in by)

    def run(t: pa.Table) -> pa.Table:
        ids, v, own = t.column("id").to_numpy(), np.stack(t.column("v").to_numpy()), t.column("own").to_numpy()
        p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
        at = {b: np.flatnonzero(own == b) for b in {p, q}}
        ways = [(p, q), (q, p)] if p != q else [(p, p)]
        found = [best(v[at[a]], ids[at[a]], v[at[b]], ids[at[b]], k, metric, self_too) for a, b in ways if len(at[a]) and len(at[b])]
        i, j, d = (np.concatenate(c) for c in zip((ids[:0], ids[:0], np.empty(0)), *found, strict=True))
        out = {"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "d": pa.array(d, pa.float64())}
        for c in by:
            out[c] = pa.array([t.column(c)[0].as_py()] * len(i), t.schema.field(c).type)
        return pa.table(out)

    return placed.groupBy(*by, "p", "q").applyInArrow(run, schema)


def balanced_knn(cells: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """i, j, d, rank, batch_j: the k nearest cells of every batch for each cell (without itself)."""
    batches = cells.select(F.col("batch").alias("batch_j")).distinct()
    left = cells.select("cell_id", "vec").join(batches)  # the few batches: each cell is asked once a batch
    right = cells.select("cell_id", "vec", F.col("batch").alias("batch_j"))
    return knn(left, right, k, metric, ("batch_j",))


def mutual(ab: DataFrame, ba: DataFrame) -> DataFrame:
    """Pairs that are among the nearest of each other: i, j, d."""
    return ab.join(ba.select(F.col("i").alias("j"), F.col("j").alias("i")), ["i", "j"]).select("i", "j", "d")


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges in both directions with the larger distance of the two."""
    both = edges.select("i", "j", "d").union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return both.groupBy("i", "j").agg(F.max("d").alias("d"))


def local_scale(edges: DataFrame) -> DataFrame:
    """i, r: mean distance to the neighbours."""
    return edges.groupBy("i").agg(F.avg("d").alias("r"))


def distance_moments(left: DataFrame, right: DataFrame, metric: str = "euclidean", by: tuple[str, ...] = (), self_too: bool = False) -> DataFrame:
    """i, mean, sd (and the `by` columns): mean and population deviation of each left row's distances to all right rows.

    Sums of pairs of blocks are added up; nothing but three numbers a row and block leaves a task.
    """
    sides = [df.select(F.col("cell_id").alias("id"), F.col("vec").alias("v"), *[F.col(c).alias(c) for c in by]) for df in (left, right)]
    counts = [s.groupBy(*by).count().agg(F.max("count")).first()[0] or 0 for s in sides]
    na, nb = (blocks(c) for c in counts)
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = sides[0].withColumn("p", dealt(na)).withColumn("q", every(nb))
    b = sides[1].withColumn("q", dealt(nb)).withColumn("p", every(na))
    kinds = {c: left.schema[c].dataType.simpleString() for c in by}

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        ids, n, total, square = np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0)
        if x.num_rows and y.num_rows:
            ids, jds = x.column("id").to_numpy(), y.column("id").to_numpy()
            vx, vy = (np.stack(t.column("v").to_numpy()) for t in (x, y))
            sums = []
            for s in range(0, len(ids), step := max(1, HELD // len(jds))):  # some rows at a time, so that what is held stays small
                d = distances(vx[s : s + step], vy, metric)
                own = np.zeros(d.shape, bool) if self_too else ids[s : s + step, None] == jds[None]
                d[own] = 0
                sums.append(((~own).sum(1).astype(float), d.sum(1), (d * d).sum(1)))
            n, total, square = (np.concatenate(c) for c in zip(*sums, strict=True))
        out = {"i": pa.array(ids, pa.int64()), "n": pa.array(n), "t": pa.array(total), "s": pa.array(square)}
        for c in by:
            t = x if x.num_rows else y
            out[c] = pa.array([t.column(c)[0].as_py()] * len(ids), t.schema.field(c).type)
        return pa.table(out)

    keys = [*by, "p", "q"]
    part = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, "i long, n double, t double, s double" + "".join(f", {c} {t}" for c, t in kinds.items()))
    sums = part.groupBy("i", *by).agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("s").alias("s")).filter("n > 0")
    mean = F.col("t") / F.col("n")
    return sums.select("i", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("s") / F.col("n") - mean * mean)).alias("sd"), *by)


HUBNESS = ("none", "local_scaling", "csls", "mutual_proximity", "rank")


def hubness(pairs: DataFrame, scale_i: DataFrame, scale_j: DataFrame, how: str = "csls") -> DataFrame:
    """pairs (i, j, d) with d reduced for hubs; the scales are i, r tables of both sides.

    none: d; local_scaling: 1 - exp(-d^2 / (r_i r_j)); csls: 2 d - r_i - r_j;
    mutual_proximity: from normal tails of each side's distances, those of the pairs given or, where the scales have the
    columns mean and sd (distance_moments), of all; rank: the average rank of d among i's pairs.
    """
    if how == "none":
        return pairs
    if how == "rank":
        w = Window.partitionBy("i")
        rank = F.rank().over(w.orderBy("d")) + (F.count(F.lit(1)).over(Window.partitionBy("i", "d")) - 1) / 2
        return pairs.withColumn("d", rank.cast("double"))
    if how == "mutual_proximity" and "sd" in scale_i.columns:
        sides = [scale.select(F.col("i").alias(c), F.col("mean").alias(f"m_{c}"), F.col("sd").alias(f"s_{c}")) for scale, c in ((scale_i, "i"), (scale_j, "j"))]
        below = lambda c: 1 / (1 + F.exp(F.lit(-1.702) * (F.col("d") - F.col(f"m_{c}")) / F.greatest(f"s_{c}", F.lit(1e-300))))
        out = pairs.join(sides[0], "i").join(sides[1], "j")
        return out.withColumn("d", 1 - (1 - below("i")) * (1 - below("j"))).drop("m_i", "s_i", "m_j", "s_j")
    if how == "mutual_proximity":
        tail = lambda c: 1 / (1 + F.exp(F.lit(-1.702) * (F.col("d") - F.avg("d").over(Window.partitionBy(c))) / F.greatest(F.stddev_pop("d").over(Window.partitionBy(c)), F.lit(1e-300))))
        return pairs.withColumn("d", 1 - (1 - tail("i")) * (1 - tail("j")))
    out = pairs.join(scale_i.select("i", F.col("r").alias("r_i")), "i").join(scale_j.select(F.col("i").alias("j"), F.col("r").alias("r_j")), "j")
    if how == "csls":
        return out.withColumn("d", 2 * F.col("d") - F.col("r_i") - F.col("r_j")).drop("r_i", "r_j")
    if how == "local_scaling":
        return out.withColumn("d", 1 - F.exp(-F.col("d") * F.col("d") / (F.col("r_i") * F.col("r_j")))).drop("r_i", "r_j")
    raise ValueError(f"unknown hubness reduction: {how}")


def hub_penalised(edges: DataFrame, k: int) -> DataFrame:
    """Of each cell's neighbours (2k of them) the k with the least in-degree, then distance, then id."""
    degree = edges.groupBy("j").agg(F.count("*").alias("in_degree"))
    w = Window.partitionBy("i").orderBy("in_degree", "d", "j")
    return edges.drop("rank").join(degree, "j").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def stratified(ranked: DataFrame, k: int, n: int, seed: int = 0) -> DataFrame:
    """Near, middle and far pairs of ranked neighbours (rank from 1, n of them): i, j, kind 1, 2 or 3.

    The k nearest are kind 1; k // 2 from the second sixth are kind 2 and 2k from the third sixth kind 3, by a hash.
    """
    sixth = max(1, n // 6)
    kind = F.when(F.col("rank") <= k, 1).when((F.col("rank") > sixth) & (F.col("rank") <= 2 * sixth), 2).when((F.col("rank") > 2 * sixth) & (F.col("rank") <= 3 * sixth), 3)
    out = ranked.withColumn("kind", kind).filter("kind is not null").withColumn("r", F.row_number().over(Window.partitionBy("i", "kind").orderBy(F.xxhash64("i", "j", F.lit(seed)), "j")))
    return out.filter((F.col("kind") == 1) | ((F.col("kind") == 2) & (F.col("r") <= k // 2)) | ((F.col("kind") == 3) & (F.col("r") <= 2 * k))).select("i", "j", "kind")


#: Rows drawn for each neighbour that `stratified_knn` keeps from a sixth, rows of distances that are sorted at a time.
DRAWN, SORTED = 12, 64
_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(h: np.ndarray, n: int) -> np.ndarray:
    return (h << np.uint64(n)) | (h >> np.uint64(64 - n))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    return h ^ (h >> np.uint64(32))


def pair_hash(i: np.ndarray, j: np.ndarray, seed: int) -> np.ndarray:
    """xxhash64(i, j, seed) of every i (rows) with every j (columns), as the column function gives it for two longs and an int."""
    with np.errstate(over="ignore"):
        word = lambda x: _rotated(x.astype(np.int64).view(np.uint64) * _P[1], 31) * _P[0]
        first = _mixed(_rotated((np.uint64(42) + _P[4] + np.uint64(8)) ^ word(i), 27) * _P[0] + _P[3])
        h = _mixed(_rotated((first + _P[4] + np.uint64(8))[:, None] ^ word(j)[None], 27) * _P[0] + _P[3])
        return _mixed(_rotated((h + _P[4] + np.uint64(4)) ^ (np.uint64(seed & 0xFFFFFFFF) * _P[0]), 23) * _P[1] + _P[2]).view(np.int64)


def _below(x: np.ndarray, ids: np.ndarray, cs: list[np.ndarray], ds: list[np.ndarray], y: np.ndarray, jds: np.ndarray, metric: str) -> list[np.ndarray]:
    """For every row the number of y that come before each of its candidates (c, d) by (distance, id), without the row itself."""
    unit, out = 4 * (x.shape[1] + 8) * np.finfo(np.float64).eps, []
    with np.errstate(all="ignore"):
        xs, ys = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y)) if metric == "cosine" else (x, y)
        square = np.zeros(len(y)) if metric == "cosine" else (y * y).sum(1)
        largest = 1.0 if metric == "cosine" else square[np.isfinite(square)].max(initial=0.0)
        own, names = _same(ids, jds), np.sort(jds)
        for s in range(0, len(x), SORTED):
            part = xs[s : s + SORTED]
            value = square[None] - 2 * (part @ ys.T)
            mine = slice(*np.searchsorted(own[0], (s, s + len(part))))
            value[own[0][mine] - s, own[1][mine]] = np.inf
            value[~np.isfinite(value)] = np.inf
            ordered = np.sort(value, axis=1)
            size = (part * part).sum(1)
            for r in range(len(part)):
                c, d, slack = cs[s + r], ds[s + r], 4 * unit * (size[r] + largest)
                t = 2 * (d - 1) if metric == "cosine" else d * d - size[r]
                lo, hi = np.searchsorted(ordered[r], t - slack), np.searchsorted(ordered[r], t + slack, "right")
                n = lo.copy()
                at = np.minimum(np.searchsorted(names, c), len(names) - 1)
                unsure = np.flatnonzero(hi - lo > (names[at] == c))  # others than the candidate that rounding may have moved across it
                if len(unsure):
                    order = np.argsort(value[r], kind="stable")
                    for u in unsure.tolist():
                        cols = order[lo[u] : hi[u]]
                        e = exact(np.broadcast_to(x[s + r], (len(cols), x.shape[1])), y[cols], metric)
                        n[u] += int(((e < d[u]) | ((e == d[u]) & (jds[cols] < c[u]))).sum())
                out.append(n)
    return out


def _lists(t: pa.Table, name: str) -> list[np.ndarray]:
    c = t.column(name).combine_chunks()
    ends = c.offsets.to_numpy()
    values = c.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _as_lists(x: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate([*x, np.empty(0, x[0].dtype if x else np.int64)]), kind))


def stratified_knn(cells: DataFrame, k: int, metric: str = "euclidean", seed: int = 0, drawn: int | None = None) -> DataFrame:
    """i, j, kind as `stratified` takes them from the n // 2 nearest of n cells, without a list of these.

    Only the pairs of least hash can be taken from a sixth, so a cell's pairs up to some hash are drawn, and their ranks are
    counted over all cells, in pairs of blocks. Cells whose sixths hold too few of them draw eight times as many, at last all.
    """
    n = cells.count()
    sixth, most = max(1, n // 6), n // 2
    near = knn(cells, cells, min(k, most), metric).select("i", "j", F.lit(1).alias("kind")) if most else None
    out = stored((near if near is not None else cells.limit(0).select(F.col("cell_id").cast("long").alias("i"), F.col("cell_id").cast("long").alias("j"), F.lit(1).alias("kind"))))
    want = {2: min(k // 2, max(0, min(2 * sixth, most) - max(sixth, k))), 3: min(2 * k, max(0, min(3 * sixth, most) - max(2 * sixth, k)))}
    if not any(want.values()):
        return out
    base = stored(cells.select(F.col("cell_id").cast("long").alias("id"), F.col("vec").alias("v")))
    parts = blocks(n)
    dealt, every = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    right = base.select(F.col("id").alias("id"), F.col("v").alias("v")).withColumn("q", dealt).withColumn("p", every)  # columns of its own
    todo, share = base, min(1.0, (drawn or DRAWN * 2 * k) / n)
    while True:
        limit = min(2**63 - 1, int(share * 2.0**64) - 2**63)

        def draw(x: pa.Table, y: pa.Table) -> pa.Table:
            ids, js, ds, hs = np.empty(0, np.int64), [], [], []
            if x.num_rows and y.num_rows:
                ids, jds = x.column("id").to_numpy(), y.column("id").to_numpy()
                vx, vy = (np.stack(t.column("v").to_numpy()) for t in (x, y))
                for s in range(0, len(ids), SORTED):
                    found = []
                    for t in range(0, len(jds), TILE[1]):
                        h = pair_hash(ids[s : s + SORTED], jds[t : t + TILE[1]], seed)
                        r, c = np.nonzero(h <= limit)  # the limit of this round, which ends before the next begins
                        found.append((r, c + t, h[r, c]))
                    r, c, h = (np.concatenate(z) for z in zip(*found, strict=True))
                    with np.errstate(all="ignore"):
                        d = np.concatenate([exact(vx[s + r[f : f + COMPARED]], vy[c[f : f + COMPARED]], metric) for f in range(0, len(r), COMPARED)] or [np.empty(0)])
                    use = np.isfinite(d) & (ids[s + r] != jds[c])
                    order = np.flatnonzero(use)[np.argsort(r[use], kind="stable")]
                    ends = np.searchsorted(r[order], np.arange(1, min(SORTED, len(ids) - s)))
                    for list_, z in ((js, jds[c[order]]), (ds, d[order]), (hs, h[order])):
                        list_ += np.split(z, ends)
            return pa.table({"i": pa.array(ids, pa.int64()), "js": _as_lists(js, pa.int64()), "ds": _as_lists(ds, pa.float64()), "hs": _as_lists(hs, pa.int64())})

        def count(x: pa.Table, y: pa.Table) -> pa.Table:
            ids, n = np.empty(0, np.int64), []
            if x.num_rows and y.num_rows:
                ids = x.column("id").to_numpy()
                vx, vy = (np.stack(t.column("v").to_numpy()) for t in (x, y))
                n = _below(vx, ids, _lists(x, "js"), _lists(x, "ds"), vy, y.column("id").to_numpy(), metric)
            return pa.table({"i": pa.array(ids, pa.int64()), "n": _as_lists(n, pa.int64())})

        left = todo.withColumn("p", dealt).withColumn("q", every)
        pairs = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(draw, "i long, js array<long>, ds array<double>, hs array<long>")
        whole = [F.flatten(F.collect_list(F.struct("js", "ds", "hs"))[c]).alias(c) for c in ("js", "ds", "hs")]  # a row a block
        pairs = stored(pairs.groupBy("i").agg(*whole))
        asked = pairs.select(F.col("i").alias("id"), "js", "ds").join(base, "id").withColumn("p", dealt).withColumn("q", every)
        counts = asked.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(count, "i long, n array<long>")
        total = F.aggregate(F.slice("l", 2, F.size("l")), F.col("l")[0], lambda s, m: F.zip_with(s, m, lambda a, b: a + b))
        ranked = pairs.join(counts.groupBy("i").agg(F.collect_list("n").alias("l")).select("i", total.alias("n")), "i")
        ranked = ranked.select("i", F.explode(F.arrays_zip("js", "hs", "n")).alias("x")).select("i", F.col("x.js").alias("j"), F.col("x.hs").alias("h"), (F.col("x.n") + 1).alias("rank"))
        between = lambda a, b: (F.col("rank") > max(a, k)) & (F.col("rank") <= min(b, most))
        ranked = ranked.withColumn("kind", F.when(between(sixth, 2 * sixth), 2).when(between(2 * sixth, 3 * sixth), 3)).filter("kind is not null")
        got = ranked.withColumn("r", F.row_number().over(Window.partitionBy("i", "kind").orderBy("h", "j")))
        got = stored(got.filter(((F.col("kind") == 2) & (F.col("r") <= k // 2)) | ((F.col("kind") == 3) & (F.col("r") <= 2 * k))).select("i", "j", "kind"))
        if share == 1.0:
            return out.union(got)
        full = got.groupBy("i").agg(*[F.sum((F.col("kind") == c).cast("int")).alias(f"n{c}") for c in (2, 3)]).filter((F.col("n2") >= want[2]) & (F.col("n3") >= want[3])).select("i")
        out = out.union(got.join(full, "i", "left_semi"))
        todo = stored(todo.join(full.withColumnRenamed("i", "id"), "id", "left_anti"))
        if todo.isEmpty():
            return out
        share = min(1.0, 8 * share)
