"""Batch correction of vectors: soft clusters with a diversity penalty and ridge regression, and matched batches joined one by one.

Cells stay where they are; what tasks send are sums by cluster and batch, or partial sums by cell, never cells of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import knn as K
from tessera.operators.stage import stored

#: A block of this many rows is worth a task where only sums are taken.
SUMMED = 16_384


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def memberships(z: np.ndarray, centres: np.ndarray, penalty: np.ndarray, batch: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Soft memberships of unit vectors in clusters of unit centres, weighted by the penalty (cluster, batch); and the distances."""
    d = 2 * (1 - z @ centres.T)
    r = np.exp(-(d - d.min(1, keepdims=True)) / sigma) * penalty[:, batch].T
    return r / r.sum(1, keepdims=True), d


def corrected(z: np.ndarray, r: np.ndarray, batch: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """z less the moves (cluster, batch, dim) by membership."""
    return z - np.einsum("ik,ikd->id", r, moves[:, batch].transpose(1, 0, 2))


def ridge_moves(weight: np.ndarray, sums: np.ndarray, ridge: float) -> np.ndarray:
    """(cluster, batch, dim) offsets of each batch from its cluster's intercept.

    weight (cluster, batch) and sums (cluster, batch, dim) are the moments of a regression on an intercept and the batches'
    indicators, the latter with a ridge penalty.
    """
    n_batches, out = weight.shape[1], np.zeros(sums.shape)
    for k in range(len(weight)):
        left = np.diag(np.concatenate([[weight[k].sum()], weight[k] + ridge]))
        left[0, 1:] = left[1:, 0] = weight[k]
        right = np.concatenate([sums[k].sum(0)[None], sums[k]])
        if weight[k].sum() > 0:
            out[k] = np.linalg.solve(left, right)[1 : n_batches + 1]
    return out


class Harmony:
    """The published iteration: soft k-means with an entropy term and a batch-diversity penalty, then ridge regression.

    Memberships of a block of cells follow from the centres and the penalty they were last updated with, so only those are
    kept, never the memberships themselves. clusters * batches * dims numbers pass the driver in a step. trace holds the
    objective after every round of clustering.
    """

    def __init__(self, cells: DataFrame, clusters: int | None = None, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, blocks: int = 5):
        self.columns, self.kind = cells.columns, cells.schema["cell_id"].dataType.simpleString()
        names = [r["batch"] for r in cells.select("batch").distinct().orderBy("batch").collect()]  # a row a batch
        sizes = {r["batch"]: r["n"] for r in cells.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.share = np.array([sizes[b] for b in names], float) / max(1, sum(sizes.values()))
        self.theta, self.sigma, self.ridge, self.blocks = theta, sigma, ridge, blocks
        self.clusters = clusters or max(1, min(100, round(sum(sizes.values()) / 30)))
        at = F.create_map(*[x for i, b in enumerate(names) for x in (F.lit(b), F.lit(i))])[F.col("batch")] if names else F.lit(0)
        dealt = F.pmod(F.xxhash64("cell_id"), F.lit(blocks)).cast("int")
        self.cells = cells
        self.data = stored(cells.select("cell_id", at.alias("b"), dealt.alias("block"), F.col("vec").alias("origin"), F.col("vec").alias("now")))
        drawn = self.data.orderBy(F.xxhash64("cell_id"), "cell_id").limit(self.clusters).collect()
        self.centres = unit(np.array([r["now"] for r in drawn])) if drawn else np.empty((0, 0))
        self.trace: list[float] = []
        flat = np.ones((len(self.centres), len(names)))
        self.state = {k: (self.centres, flat) for k in range(blocks)}

    def _sums(self, data: DataFrame, make: Callable[[dict], list[np.ndarray]]) -> list[np.ndarray]:
        """Sums over all cells of the arrays that make returns for a slice of cells, by partial sums a task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: list[np.ndarray] | None = None
            for b in batches:
                if b.num_rows:
                    part = make(_columns(b))
                    total = part if total is None else [x + y for x, y in zip(total, part, strict=True)]
            for i, x in enumerate(total or ()):
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([x.ravel().tolist()], pa.list_(pa.float64())), pa.array([list(x.shape)], pa.list_(pa.int64()))], names=["part", "x", "shape"])

        out: dict[int, np.ndarray] = {}
        for r in data.mapInArrow(run, "part long, x array<double>, shape array<long>").orderBy("part").toLocalIterator():  # a few rows a task
            x = np.array(r["x"]).reshape(r["shape"])
            out[r["part"]] = out[r["part"]] + x if r["part"] in out else x
        return [out[k] for k in sorted(out)]

    def cluster(self, rounds: int, tolerance: float) -> None:
        """Rounds of centres, then memberships block by block, until the objective falls by less than the tolerance."""
        sigma, n_batches = self.sigma, len(self.share)
        own = [self._sums(self.data.filter(F.col("block") == k), self._moments(*self.state[k])) for k in range(self.blocks)]
        start = len(self.trace)
        for _ in range(rounds):
            known = [x for x in own if x]
            if not known:
                return
            self.centres = unit(sum(x[1] for x in known))
            for k in range(self.blocks):
                other = sum((x[0] for j, x in enumerate(own) if j != k and x), np.zeros((len(self.centres), n_batches)))
                expected = other.sum(1, keepdims=True) * self.share[None]
                self.state[k] = (self.centres, ((expected + 1) / (other + 1)) ** self.theta)
                own[k] = self._sums(self.data.filter(F.col("block") == k), self._moments(*self.state[k]))
            known = [x for x in own if x]
            seen = sum(x[0] for x in known)
            expected = seen.sum(1, keepdims=True) * self.share[None]
            self.trace.append(float(sum(x[2].sum() for x in known) + sigma * self.theta * (seen * np.log((seen + 1) / (expected + 1))).sum()))
            if len(self.trace) > start + 1 and self.trace[-2] - self.trace[-1] < tolerance * abs(self.trace[-2]):
                return

    def _moments(self, centres: np.ndarray, penalty: np.ndarray) -> Callable[[dict], list[np.ndarray]]:
        """Members by (cluster, batch), sums of unit vectors by cluster, and the cells' part of the objective."""
        sigma = self.sigma

        def make(c: dict) -> list[np.ndarray]:
            z = unit(c["now"])
            r, d = memberships(z, centres, penalty, c["b"], sigma)
            seen = np.zeros(penalty.shape)
            np.add.at(seen.T, c["b"], r)
            return [seen, r.T @ z, np.array([(r * d).sum() + sigma * (r * np.log(np.maximum(r, 1e-300))).sum()])]

        return make

    def correct(self) -> float:
        """Moves cells by the ridge regression of each cluster; the mean length of the moves."""
        state, sigma = self.state, self.sigma

        def make(c: dict) -> list[np.ndarray]:
            weight, sums = np.zeros(state[0][1].shape), np.zeros((*state[0][1].shape, c["now"].shape[1]))
            for k in np.unique(c["block"]).tolist():
                m = c["block"] == k
                r, _ = memberships(unit(c["now"][m]), *state[k], c["b"][m], sigma)
                np.add.at(weight.T, c["b"][m], r)
                np.add.at(sums.transpose(1, 0, 2), c["b"][m], r[:, :, None] * c["origin"][m][:, None])
            return [weight, sums]

        moments = self._sums(self.data, make)
        if not moments:
            return 0.0
        moves = ridge_moves(*moments, self.ridge)
        kind = self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                c = _columns(b)
                out = np.array(c["now"], float)
                for k in np.unique(c["block"]).tolist() if b.num_rows else ():
                    m = c["block"] == k
                    r, _ = memberships(unit(c["now"][m]), *state[k], c["b"][m], sigma)
                    out[m] = corrected(c["origin"][m], r, c["b"][m], moves)
                far = np.linalg.norm(out - c["now"], axis=1) if b.num_rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(list(out) if b.num_rows else [], pa.list_(pa.float64())), pa.array(far)], names=["cell_id", "b", "block", "origin", "now", "far"])

        moved = stored(self.data.mapInArrow(run, f"cell_id {kind}, b int, block int, origin array<double>, now array<double>, far double"))
        self.data = moved.drop("far")
        return float(moved.agg(F.avg("far")).first()[0] or 0.0)

    def run(self, rounds: int = 10, cluster_rounds: int = 20, tolerance: float = 1e-4, cluster_tolerance: float = 1e-5) -> DataFrame:
        scale = None
        for _ in range(rounds):
            self.cluster(cluster_rounds, cluster_tolerance)
            far = self.correct()
            scale = scale or far
            if not far or far < tolerance * scale:
                break
        now = self.data.select("cell_id", F.col("now").alias("__now"))
        return self.cells.join(now, "cell_id").withColumn("vec", F.col("__now")).select(*self.columns)


def _columns(b: pa.RecordBatch) -> dict:
    """A slice of Harmony's table as arrays; vectors as matrices."""
    out = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("b", "block")}
    for n in ("origin", "now"):
        out[n] = np.stack(b.column(n).to_numpy(zero_copy_only=False)) if b.num_rows else np.empty((0, 0))
    return out


def harmony(cells: DataFrame, clusters: int | None = None, rounds: int = 10, cluster_rounds: int = 20, **options) -> DataFrame:
    """cells with corrected vectors; see Harmony. A cell of a batch's only cluster mates moves with its batch."""
    return Harmony(cells, clusters, **options).run(rounds, cluster_rounds)


def alignment_scores(cells: DataFrame, matches: DataFrame) -> DataFrame:
    """a, b, score for a < b: the larger of the shares of a's and of b's cells that have a match (a, b, i, j) in the other."""
    size = cells.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    seen = matches.groupBy("a", "b").agg(F.count_distinct("i").alias("ni"), F.count_distinct("j").alias("nj"))
    both = seen.join(size.select(F.col("batch").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("batch").alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", F.greatest(F.col("ni") / F.col("na"), F.col("nj") / F.col("nb")).alias("score"))


def merge_order(scores: list[tuple], sizes: dict, least: float) -> list[tuple[tuple, tuple]]:
    """(batches that move, batches they join), from (a, b, score) with the best first: the smaller group moves onto the larger."""
    group = {b: (b,) for b in sizes}
    out = []
    for a, b, s in sorted(scores, key=lambda x: (-x[2], x[0], x[1])):
        ga, gb = group[a], group[b]
        if s < least or ga == gb:
            continue
        weigh = lambda g: (sum(sizes[x] for x in g), min(g))
        small, large = sorted((ga, gb), key=weigh)
        out.append((small, large))
        whole = tuple(sorted(small + large))
        group |= dict.fromkeys(whole, whole)
    return out


def _listed(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists, without a Python object a number."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), pa.float64()))


def _added(parts: DataFrame, key: str) -> DataFrame:
    """key, w, m: the sums of rows (key, w, m), of which there is one a block."""
    whole = parts.groupBy(key).agg(F.sum("w").alias("w"), F.collect_list("m").alias("l"))
    total = F.aggregate(F.slice("l", 2, F.size("l")), F.col("l")[0], lambda s, m: F.zip_with(s, m, lambda a, b: a + b))
    return whole.select(key, "w", total.alias("m"))


def linked_sums(links: DataFrame, points: DataFrame) -> DataFrame:
    """i, w, m: the sums of w and of w times the vector of j over the links (i, j, w) of each i; points has cell_id and vec.

    Links meet vectors in pairs of blocks, so a vector travels once a block of i and a sum once a block of j, however many
    links there are.
    """
    na, nb = (K.blocks(n, SUMMED) for n in (links.agg(F.approx_count_distinct("i")).first()[0], points.count()))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    x = links.select("i", "j", F.col("w").cast("double").alias("w"), dealt("i", na).alias("p"), dealt("j", nb).alias("q"))
    y = points.select(F.col("cell_id").alias("id"), F.col("vec").alias("v"), dealt("cell_id", nb).alias("q")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(na - 1))))

    def run(s: pa.Table, t: pa.Table) -> pa.Table:
        ids, w, m = np.empty(0, np.int64), np.empty(0), np.empty((0, 1))
        if s.num_rows and t.num_rows:
            v = np.stack(t.column("v").to_numpy())
            i, j, weight = (s.column(c).to_numpy() for c in ("i", "j", "w"))
            link, at = K._same(j, t.column("id").to_numpy())
            order = np.lexsort((j[link], i[link]))
            link, at = link[order], at[order]
            ids, row = np.unique(i[link], return_inverse=True)
            w, m = np.bincount(row, weight[link], len(ids)), np.zeros((len(ids), v.shape[1]))
            for r in range(0, len(link), K.COMPARED):  # some links at a time, so that what is held stays small
                part = slice(r, r + K.COMPARED)
                starts = np.flatnonzero(np.diff(row[part], prepend=-1))
                m[row[part][starts]] += np.add.reduceat(v[at[part]] * weight[link[part], None], starts)
        return pa.table({"i": pa.array(ids, pa.int64()), "w": pa.array(w, pa.float64()), "m": _listed(m)})

    return _added(x.groupBy("p", "q").cogroup(y.groupBy("p", "q")).applyInArrow(run, "i long, w double, m array<double>"), "i")


def _moved(cells: DataFrame, bias: DataFrame, gamma: float) -> DataFrame:
    """cells moved by the mean of the biases (id, at, move), weighted by exp(-gamma d^2) of their place, in pairs of blocks.

    A bias with a column n stands for n of one place, and its move is their sum.
    """
    bias = bias.select("id", "at", "move", (F.col("n").cast("double") if "n" in bias.columns else F.lit(1.0)).alias("n"))
    counts = [df.count() for df in (cells, bias)]
    na, nb = (K.blocks(n) for n in counts)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = cells.select("cell_id", F.col("vec").alias("v")).withColumn("p", F.pmod(F.xxhash64("cell_id"), F.lit(na)).cast("int")).withColumn("q", every(nb))
    y = bias.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int")).withColumn("p", every(na))

    def run(s: pa.Table, t: pa.Table) -> pa.Table:
        ids, w, m = np.empty(0, np.int64), np.empty(0), np.empty((0, 1))
        if s.num_rows and t.num_rows:
            ids, n = s.column("cell_id").to_numpy(), t.column("n").to_numpy()
            vx, at, move = (np.stack(c.to_numpy()) for c in (s.column("v"), t.column("at"), t.column("move")))
            part, step = [], max(1, K.HELD // len(at))
            for r in range(0, len(ids), step):  # some rows at a time, so that what is held stays small
                kernel = np.exp(-gamma * K.distances(vx[r : r + step], at, "euclidean") ** 2)
                part.append((kernel @ n, kernel @ move))
            w, m = (np.concatenate(c) for c in zip(*part, strict=True))
        return pa.table({"cell_id": pa.array(ids, pa.int64()), "w": pa.array(w, pa.float64()), "m": _listed(m)})

    whole = _added(x.groupBy("p", "q").cogroup(y.groupBy("p", "q")).applyInArrow(run, "cell_id long, w double, m array<double>"), "cell_id")
    shift = whole.select("cell_id", F.transform("m", lambda x: F.when(F.col("w") > 0, x / F.col("w")).otherwise(0.0)).alias("shift"))
    out = cells.join(shift, "cell_id", "left")
    return out.withColumn("vec", F.when(F.col("shift").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "shift", lambda a, b: a + b))).drop("shift")


def _biases(link: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """id, at, move, n of each linked cell of `own`: its place, the sum of its moves onto the cells it is linked to, and their number."""
    sums = linked_sums(link.select("i", "j", F.lit(1.0).alias("w")), other).withColumnRenamed("i", "cell_id")
    at = own.select("cell_id", F.col("vec").alias("at")).join(sums, "cell_id")
    return at.select(F.col("cell_id").alias("id"), "at", F.zip_with("m", "at", lambda s, x: s - F.col("w") * x).alias("move"), F.col("w").alias("n"))


def scanorama(cells: DataFrame, k: int = 20, least: float = 0.1, sigma: float = 15.0) -> DataFrame:
    """cells with unit vectors, the batches joined in the order of how well they match.

    Two cells of different batches match if each is among the other's k nearest of that batch. Pairs of batches with a score
    (see alignment_scores) of `least` or more are taken from the best on; the smaller group of batches is moved onto the larger by
    the matches between any of their members, each cell by the mean move of the matched cells, weighted by a Gaussian
    kernel of sigma. No batch is a reference; a batch without matches stays as it is.
    """
    columns = cells.columns
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    now = stored(cells.withColumn("vec", F.transform("vec", lambda x: x / F.when(norm > 0, norm).otherwise(1.0))))
    batches = now.select(F.col("batch").alias("batch_j")).distinct()
    asked = now.select("cell_id", "vec", "batch").join(batches, F.col("batch") != F.col("batch_j"))  # the few other batches
    near = K.knn(asked, now.select("cell_id", "vec", F.col("batch").alias("batch_j")), k, by=("batch_j",)).select("i", "j", "batch_j")
    near = stored(near.join(now.select(F.col("cell_id").alias("i"), F.col("batch").alias("batch_i")), "i").select("i", "j", "batch_i", "batch_j"))
    back = near.select(F.col("j").alias("i"), F.col("i").alias("j"))
    matches = stored(near.filter("batch_i < batch_j").join(back, ["i", "j"]).select(F.col("batch_i").alias("a"), F.col("batch_j").alias("b"), "i", "j"))
    scores = [tuple(r) for r in alignment_scores(now, matches).collect()]  # a row a pair of batches
    sizes = {r["batch"]: r["n"] for r in now.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a batch
    both = matches.union(matches.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("j").alias("i"), F.col("i").alias("j")))
    for small, large in merge_order(scores, sizes, least):
        link = both.filter(F.col("a").isin(*small) & F.col("b").isin(*large))
        moves = F.col("batch").isin(*small)
        bias = stored(_biases(link, now.filter(moves), now.filter(F.col("batch").isin(*large))))  # a row a matched cell, not a match
        now = stored(now.filter(~moves).unionByName(_moved(now.filter(moves), bias, 0.5 * sigma).select(*columns)))
    return now.select(*columns)
