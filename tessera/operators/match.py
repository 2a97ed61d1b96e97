"""One-to-one matches between batches.

A pair of batches of at most HELD distances is solved exactly, in one task. A larger one is solved by an auction over many
tasks (`auction`), whose total cost is at most 1 + slack times the least one. A caller may move the border: with
exact_up_to=None every pair is solved exactly, whatever its size, and with 0 every pair by the auction.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import knn as K
from tessera.operators.auction import Auction, reduced
from tessera.operators.knn import distances
from tessera.operators.stage import stored

HELD = 16_000_000


def least_pairs(n: int, m: int, row_of: Callable[[int], np.ndarray]) -> list[tuple[int, int, float]]:
    """(row, column, cost) of least total cost for n <= m, by shortest augmenting paths with potentials.

    row_of(i) gives the m costs of row i; pairs whose cost is not finite are left out.
    """
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, np.int64)  # row of each column, from 1
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while True:
            used[at] = True
            free = ~used[1:]
            c = row_of(int(owner[at]) - 1)
            step = np.where(np.isfinite(c), c, 1e12) - u[owner[at]] - v[1:]
            better = free & (step < least[1:])
            least[1:][better] = step[better]
            back[1:][better] = at
            nxt = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            at = nxt
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    taken = [(int(owner[col]) - 1, col - 1) for col in range(1, m + 1) if owner[col]]
    return [(i, j, d) for i, j in taken if np.isfinite(d := float(row_of(i)[j]))]


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row of least total cost (-1: none)."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    out = np.full(cost.shape[0], -1, np.int64)
    for i, j, _ in least_pairs(*c.shape, lambda i: c[i]):
        out[j if flipped else i] = i if flipped else j
    return out


HUBNESS = ("none", "csls", "local_scaling", "mutual_proximity")


def local_scales(a: np.ndarray, b: np.ndarray, metric: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean distance of each row of a to its k nearest rows of b, and of each row of b to its k nearest rows of a."""

    def one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        step, out = max(1, HELD // max(1, len(y))), []
        for s in range(0, len(x), step):
            out.append(np.partition(distances(x[s : s + step], y, metric), min(k, len(y)) - 1, axis=1)[:, :k].mean(1))
        return np.concatenate(out)

    return one(a, b), one(b, a)


def moments(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each row's distances to all rows of the other side, as two columns."""

    def one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        step, out = max(1, HELD // max(1, len(y))), []
        for s in range(0, len(x), step):
            d = distances(x[s : s + step], y, metric)
            out.append(np.stack([d.mean(1), d.std(1)], 1))
        return np.concatenate(out)

    return one(a, b), one(b, a)


def nearest_pairs(x: np.ndarray, y: np.ndarray, rounds: int, metric: str, hub: str = "none", hub_k: int = 12) -> list[tuple[int, int, float, int]]:
    """(row of x, row of y, distance, round); pairs of a round are closed for later ones.

    With `hub` distances are reduced for hubs by both sides' mean distance to their hub_k nearest of the other side:
    csls: 2 d - r_i - r_j; local_scaling: 1 - exp(-d^2 / (r_i r_j)); mutual_proximity: 1 - (1 - F_i(d)) (1 - F_j(d)), F the normal
    distribution (in its logistic form) of a cell's distances to the whole other side.
    """
    if hub not in HUBNESS:
        raise ValueError(f"unknown hubness reduction between batches: {hub}")
    flipped = len(x) > len(y)
    a, b = (y, x) if flipped else (x, y)
    whole = distances(a, b, metric) if len(a) * len(b) <= HELD else None
    if hub == "mutual_proximity":
        scale_a, scale_b = moments(a, b, metric)
    else:
        scale_a, scale_b = local_scales(a, b, metric, hub_k) if hub != "none" else (None, None)
    closed: dict[int, list[int]] = {}

    def row_of(i: int) -> np.ndarray:
        d = distances(a[i : i + 1], b, metric)[0] if whole is None else whole[i]
        if hub != "none":
            d = reduced(d[None], hub, scale_a[i : i + 1], scale_b)[0]
        if i in closed:
            d = d.copy()
            d[closed[i]] = np.inf
        return d

    found = []
    for r in range(rounds):
        pairs = least_pairs(len(a), len(b), row_of)
        for i, j, _ in pairs:
            closed.setdefault(i, []).append(j)
        found += [(j, i, d, r) if flipped else (i, j, d, r) for i, j, d in pairs]
    return found


def stairs(cells: DataFrame, steps: tuple[int, ...] | None = None) -> DataFrame:
    """a, b: pairs of batches a < b, all or those whose positions differ by one of `steps`."""
    b = cells.select("batch").distinct().withColumn("at", F.row_number().over(Window.orderBy("batch")))  # one row a batch
    x, y = b.select(F.col("batch").alias("a"), F.col("at").alias("p")), b.select(F.col("batch").alias("b"), F.col("at").alias("q"))
    out = x.join(y, F.col("p") < F.col("q"))
    return (out.filter((F.col("q") - F.col("p")).isin(*steps)) if steps else out).select("a", "b")


def _scales(cells: DataFrame, pairs: DataFrame, metric: str, hub: str, k: int) -> DataFrame:
    """a, b, id, s: mean distance of each cell to its k nearest of the other batch of each pair, or moments of all its distances."""
    base = cells.select("cell_id", "vec", "batch")
    a, b = (base.withColumnRenamed("batch", c).join(pairs, c) for c in ("a", "b"))
    a, b = a.select("cell_id", "vec", "a", "b"), b.select(*[F.col(c).alias(c) for c in ("cell_id", "vec", "a", "b")])
    if hub == "mutual_proximity":
        both = [K.distance_moments(x, y, metric, ("a", "b"), True) for x, y in ((a, b), (b, a))]
        return both[0].unionByName(both[1]).select("a", "b", F.col("i").alias("id"), F.array("mean", "sd").alias("s"))
    both = K.knn(a, b, k, metric, ("a", "b"), True).union(K.knn(b, a, k, metric, ("a", "b"), True))
    return both.groupBy("a", "b", F.col("i").alias("id")).agg(F.array(F.avg("d")).alias("s"))


def matched(
    cells: DataFrame, pairs: DataFrame, rounds: int = 1, metric: str = "euclidean", max_batch: int | None = None, hub: str = "none", hub_k: int = 12, exact_up_to: int | None = HELD, slack: float = 0.01, region: int | None = None
) -> DataFrame:
    """a, b, i, j, d, round: the matches of least total cost of each pair of batches; matched pairs are closed for later rounds.

    Pairs of more than exact_up_to distances go to the auction, within `slack` of the least total cost, with about `region`
    bidders a task; rounds that could close so many pairs that the rest has no complete match are solved exactly. A caller
    who wants an error for batches beyond some size gives max_batch.
    """
    pairs = pairs.select("a", "b")
    if exact_up_to is None:
        return _matched_locally(cells, pairs, rounds, metric, max_batch, hub, hub_k)
    sizes = cells.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    known = pairs.join(sizes.select(F.col("batch").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("batch").alias("b"), F.col("n").alias("nb")), "b")
    feasible = (F.col("na") == F.col("nb")) | (F.abs(F.col("na") - F.col("nb")) >= rounds - 1)
    known = stored(known.withColumn("large", (F.col("na") * F.col("nb") > exact_up_to) & feasible & (F.least("na", "nb") >= rounds)))  # a row a pair of batches
    small, large = (known.filter(c).select("a", "b") for c in ("not large", "large"))
    if large.isEmpty():
        return _matched_locally(cells, small, rounds, metric, max_batch, hub, hub_k)
    if max_batch is not None and (most := known.agg(F.max(F.greatest("na", "nb"))).first()[0]) > max_batch:
        raise ValueError(f"a batch of {most} cells is beyond the size asked for ({max_batch}); subsample first")
    if hub not in HUBNESS:
        raise ValueError(f"unknown hubness reduction between batches: {hub}")
    scales = stored(_scales(cells, large, metric, hub, hub_k)) if hub != "none" else None
    out = Auction(cells, large, metric, slack, stored, hub, scales, **({"region": region} if region else {})).rounds(rounds)
    return out if small.isEmpty() else out.union(_matched_locally(cells, small, rounds, metric, max_batch, hub, hub_k))


def _matched_locally(cells: DataFrame, pairs: DataFrame, rounds: int, metric: str, max_batch: int | None, hub: str, hub_k: int) -> DataFrame:
    """The exact matches, a pair of batches in one task."""
    left, right = (cells.select(F.col("cell_id").alias("id"), F.col("vec").alias("v"), F.col("batch").alias(c)).join(pairs, c) for c in ("a", "b"))
    kind = cells.schema["batch"].dataType.simpleString()
    left = cells.select(F.col("cell_id").alias("id"), F.col("vec").alias("v"), F.col("batch").alias("a")).join(F.broadcast(pairs.select(F.col("a").alias("a"), F.col("b").alias("b"))), "a")
    right = cells.select(F.col("cell_id").alias("id"), F.col("vec").alias("v"), F.col("batch").alias("b")).join(F.broadcast(pairs.select(F.col("a").alias("a"), F.col("b").alias("b"))), "b")

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        found = []
        if x.num_rows and y.num_rows:
            if max_batch is not None and max(x.num_rows, y.num_rows) > max_batch:
                raise ValueError(f"a batch of {max(x.num_rows, y.num_rows)} cells is beyond the size asked for ({max_batch}); subsample first")
            x, y = x.sort_by("id"), y.sort_by("id")
            a, b = x.column("a")[0].as_py(), x.column("b")[0].as_py()
            ids, jds = x.column("id").to_pylist(), y.column("id").to_pylist()
            vx, vy = (np.stack(t.column("v").to_numpy()) for t in (x, y))
            found = [(a, b, ids[i], jds[j], d, r) for i, j, d, r in nearest_pairs(vx, vy, rounds, metric, hub, hub_k)]
        columns = list(zip(*found, strict=True)) or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, [arrow, arrow, pa.int64(), pa.int64(), pa.float64(), pa.int32()], strict=True)], names=["a", "b", "i", "j", "d", "round"])

    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(run, f"a {kind}, b {kind}, i long, j long, d double, round int")


def outlier_cut(matches: DataFrame, keep: float, by: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Matches with d up to that of position floor(n * keep) of the sorted ones of their group (0 < keep < 1), else all."""
    if not 0 < keep < 1:
        return matches
    w = Window.partitionBy(*by)
    at = F.row_number().over(w.orderBy("d", "i", "j"))
    limit = F.max(F.when(F.col("__r") == F.floor(F.col("__n") * keep) + 1, F.col("d"))).over(w)
    out = matches.withColumns({"__r": at, "__n": F.count(F.lit(1)).over(w)}).withColumn("__limit", limit)
    return out.filter(F.col("d") <= F.col("__limit")).drop("__r", "__n", "__limit")


def scaled(matches: DataFrame, scale: DataFrame, keep: float, scaling: float) -> DataFrame:
    """Matches with weights: 0 beyond the cut, else d over the distance at the scaling quantile, times both local scales' mean."""
    w = Window.partitionBy("a", "b")
    at = F.row_number().over(w.orderBy("d", "i", "j"))
    out = matches.withColumns({"__r": at, "__n": F.count(F.lit(1)).over(w)})
    nth = lambda q: F.max(F.when(F.col("__r") == F.least(F.floor(F.col("__n") * q) + 1, F.col("__n")), F.col("d"))).over(w)
    out = out.withColumns({"__cut": nth(keep), "__unit": nth(scaling)})
    out = out.join(scale.select("i", F.col("r").alias("r_i")), "i").join(scale.select(F.col("i").alias("j"), F.col("r").alias("r_j")), "j")
    weight = F.when(F.col("d") > F.col("__cut"), 0.0).otherwise(F.col("d") / F.col("__unit") * (F.col("r_i") + F.col("r_j")) / 2)
    return out.withColumn("weight", weight).drop("__r", "__n", "__cut", "__unit", "r_i", "r_j")


def aligned(cells: DataFrame, metric: str = "euclidean", max_batch: int | None = None) -> DataFrame:
    """cell_id, batch, position: cells of each batch in the order of their matches from the batch before."""
    order = [r["batch"] for r in cells.select("batch").distinct().orderBy("batch").collect()]  # a row a batch
    first = cells.filter(F.col("batch") == order[0]).withColumn("position", F.row_number().over(Window.partitionBy("batch").orderBy("cell_id")))
    out = last = first.select("cell_id", "batch", "position")
    steps = matched(cells, stairs(cells, (1,)), 1, metric, max_batch).select("a", "b", "i", "j")
    for b in order[1:]:
        last = steps.filter(F.col("b") == b).join(last.select(F.col("cell_id").alias("i"), "position"), "i").select(F.col("j").alias("cell_id"), F.lit(b).cast(cells.schema["batch"].dataType).alias("batch"), "position")
        out = out.union(last)
    return out
