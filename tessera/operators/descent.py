"""Approximate nearest neighbours by neighbour descent: a first graph from random Voronoi trees, improved by neighbours of neighbours.

The trees divide every node of more than `leaf` rows among a few of its own rows, drawn by a hash: those of more than
ROWS_A_TASK in rounds that take all trees and nodes at once, the others each in one task, which compares its leaves in full. In a round of the descent the neighbours of a cell, and a few of those
that have it as their neighbour, are compared with each other where one of the two is new to its list. This is done in pairs of
blocks of cells (see `knn.blocks`): a task holds the vectors of two blocks and, of every cell's list, the members that lie in
them, so that a pair is compared in one task only and a vector is sent once a block, however many lists lead to it. Of what it
finds for a cell a task returns a list at most. The descent ends when a round changes at most a share `change` of the lists.

No task holds more than a part of a node, a whole one of at most ROWS_A_TASK rows, or two blocks with the members in them. Lists only come nearer, so the
rounds end by themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import knn as K
from tessera.operators.stage import stored

PIVOTS = 8
ROWS_A_TASK = 50_000
#: Blocks of cells, until they have K.LARGE rows, and rows that are worth one; pairs that are formed and pairs whose distances are taken at a time.
BLOCKS, BLOCK, FORMED, PAIRS_AT_ONCE = 4, 2048, 500_000, 50_000


def usable(cells: DataFrame, metric: str) -> DataFrame:
    """id, v of the rows that take part: ids and vectors without nulls, finite, not zero for cosine; the least vector of an id."""
    whole = cells.select(F.col("cell_id").alias("id"), F.col("vec").cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    whole = whole.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if metric == "cosine":
        whole = whole.filter(F.exists("v", lambda x: x != 0))
    return whole.groupBy("id").agg(F.min("v").alias("v"))


def _hashed(ids: np.ndarray, r: int) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(2 * r + 1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(33)


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None] if metric == "cosine" else x


def _vectors(t: pa.Table, name: str = "v") -> np.ndarray:
    return np.stack(t.column(name).to_numpy()).astype(np.float64, copy=False)


def _chosen(ids: np.ndarray, v: np.ndarray, pivots: np.ndarray, r: int) -> np.ndarray:
    """Of each row the nearest pivot; copies of one vector are dealt out among equally near ones, anew in each round."""
    far = np.stack([((v - q) ** 2).sum(1) for q in pivots], 1)
    nearest = far == far.min(1)[:, None]
    turn = _hashed(ids, r) % nearest.sum(1).astype(np.uint64)
    return np.argmax(np.cumsum(nearest, 1) > turn[:, None].astype(np.int64), 1)


def _divider(metric: str, r: int):
    def divide(x: pa.Table, p: pa.Table) -> pa.Table:
        if not (x.num_rows and p.num_rows):
            return x.slice(0, 0).drop_columns(["salt"]).append_column("slot", pa.array([], pa.int32()))
        p = p.sort_by("slot")
        chosen = _chosen(x.column("id").to_numpy(), _unit(_vectors(x), metric), _unit(_vectors(p, "pv"), metric), r)
        return x.drop_columns(["salt"]).append_column("slot", pa.array(p.column("slot").to_numpy()[chosen], pa.int32()))

    return divide


def forest(rows: DataFrame, trees: int, leaf: int, metric: str, seed: int = 0) -> tuple[DataFrame, int]:
    """(id, v, tree, node: every row's node of at most ROWS_A_TASK rows, or `leaf` if that is more, in each of the trees; the rounds that this took)."""
    work = rows.withColumns({"tree": F.explode(F.sequence(F.lit(0), F.lit(trees - 1))), "node": F.lit(0).cast("long")}).select("id", "v", "tree", "node")
    schema, most, r = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in work.schema), max(leaf, ROWS_A_TASK), 0
    while True:
        size = stored(work.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most))  # few nodes
        if size.isEmpty():
            return work, r
        sized = work.join(F.broadcast(size), ["tree", "node"], "left")
        done, large = sized.filter("n is null").drop("n").select("id", "v", "tree", "node"), sized.filter("n is not null")
        draw = F.xxhash64("id", "tree", F.lit(seed), F.lit(r))
        parts = F.greatest(F.lit(2), F.least(F.lit(PIVOTS), F.ceil(2 * F.col("n") / leaf)))
        salts = F.ceil(F.col("n") / ROWS_A_TASK).cast("int")
        large = large.withColumns({"slot": F.pmod(draw, parts).cast("int"), "h": F.xxhash64(draw), "salts": salts})
        pivots = large.groupBy("tree", "node", "slot").agg(F.min_by("v", F.struct("h", "id")).alias("pv"), F.max("salts").alias("salts"))
        pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(*[F.col(c).alias(c) for c in ("tree", "node", "salt", "slot", "pv")])
        large = large.select("id", "v", "tree", "node", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
        keys = ["tree", "node", "salt"]
        split = large.groupBy(*keys).cogroup(pivots.groupBy(*keys)).applyInArrow(_divider(metric, r), schema + ", slot int")
        work = stored(split.withColumn("node", F.xxhash64("tree", "node", "slot", F.lit(r))).drop("slot").union(done))
        r += 1


def _leaves(ids: np.ndarray, v: np.ndarray, leaf: int, draw: int, r: int):
    """Rows of every leaf below a node."""
    todo = [(np.arange(len(ids)), r)]
    while todo:
        at, r = todo.pop()
        if len(at) <= leaf:
            yield at
            continue
        parts = max(2, min(PIVOTS, -(-2 * len(at) // leaf)))
        chosen = _chosen(ids[at], v[at], v[at[np.argsort(_hashed(ids[at], draw + r), kind="stable")[:parts]]], r)
        todo += [(part, r + 1) for c in range(parts) if len(part := at[chosen == c])]


def _leaf_lists(nodes: DataFrame, leaf: int, width: int, metric: str, seed: int, r: int) -> DataFrame:
    """i, j, d: the `width` nearest of each row in its leaves; a row without i for each node has the number of its comparisons as d."""

    def run(key: tuple, x: pa.Table) -> pa.Table:
        ids, v, made = x.column("id").to_numpy(), _vectors(x), 0
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for at in _leaves(ids, _unit(v, metric), leaf, (seed + 1) * 1_000_003 + (key[0].as_py() + 1) * 1_009, r):
            made += len(at) * (len(at) - 1) // 2
            if len(at) > 1:
                out.append(K.best(v[at], ids[at], v[at], ids[at], width, metric, False))
        return _with_count(*(np.concatenate(c) for c in zip(*out, strict=True)), made)

    return nodes.select("id", "v", "tree", "node").groupBy("tree", "node").applyInArrow(run, "i long, j long, d double")


def _with_count(i: np.ndarray, j: np.ndarray, d: np.ndarray, made: int) -> pa.Table:
    last = (pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([float(made)]))
    return pa.table({c: pa.chunked_array([pa.array(z), one]) for c, z, one in zip("ijd", (i, j, d), last, strict=True)})


def _counted(found: DataFrame) -> tuple[DataFrame, Observation]:
    """The pairs, and the number of comparisons, which is known when they have been written."""
    seen = Observation()
    return found.observe(seen, F.sum(F.when(F.col("i").isNull(), F.col("d"))).alias("compared")).filter("i is not null"), seen


def _nearest(pairs: DataFrame, width: int) -> DataFrame:
    """The `width` nearest of each i, one row a pair (its oldest), ties to the smaller j."""
    one = pairs.repartition("i").groupBy("i", "j").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).filter(F.col("rank") <= width)


def _members(graph: DataFrame, width: int, r: int, seed: int) -> DataFrame:
    """w, u, fresh: the neighbours of each cell, and at most `width` of those whose neighbour it is."""
    back = graph.withColumn("h", F.xxhash64("i", "j", F.lit(seed), F.lit(r)))
    back = back.withColumn("n", F.row_number().over(Window.partitionBy("j").orderBy(F.desc("fresh"), "h", "i"))).filter(F.col("n") <= width)
    both = graph.select(F.col("i").alias("w"), F.col("j").alias("u"), "fresh").union(back.select(F.col("j").alias("w"), F.col("i").alias("u"), "fresh"))
    return both.repartition("w").groupBy("w", "u").agg(F.max("fresh").alias("fresh"))


def _listed(members: DataFrame, parts: int) -> DataFrame:
    """p, q, own, w, new, old: each cell's members of block `own`, for every pair of blocks (p <= q) that has one of them fresh."""
    block = F.pmod(F.xxhash64("u"), F.lit(parts)).cast("int")
    lists = members.groupBy("w", block.alias("own")).agg(F.collect_list(F.when(F.col("fresh"), F.col("u"))).alias("new"), F.collect_list(F.when(~F.col("fresh"), F.col("u"))).alias("old"))
    w, any_new = Window.partitionBy("w"), F.size("new") > 0
    sides = lists.withColumns({"all": F.collect_set("own").over(w), "some": F.collect_set(F.when(any_new, F.col("own"))).over(w)})
    dealt = sides.withColumn("other", F.explode(F.when(any_new, F.col("all")).otherwise(F.col("some")))).filter("other <> own or size(new) + size(old) > 1")
    return dealt.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "w", "new", "old")


def _entries(m: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """w, own, u, fresh of every member in the lists."""
    w, own, out = m.column("w").to_numpy(), m.column("own").to_numpy(), []
    for name in ("new", "old"):
        c = m.column(name).combine_chunks()
        n, u = np.diff(c.offsets.to_numpy()), c.flatten().to_numpy()
        out.append((np.repeat(w, n), np.repeat(own, n), u, np.full(len(u), name == "new")))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _fellows(left: tuple, right: tuple, n: int):
    """Distinct pairs a * n + b of fellow members, one of them fresh, a part at a time; a left row's pairs come together.

    left and right are (w, u, fresh), left in order of u, right of w; n is more than any u.
    """
    first, last = (np.searchsorted(right[0], left[0], side) for side in ("left", "right"))
    upto, held, s = np.cumsum(last - first), np.empty(0, np.int64), 0
    while s < len(upto):
        e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + FORMED, "right")))
        width = (last - first)[s:e]
        at = np.repeat(np.arange(s, e), width)
        to = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width) + first[at]
        use = (left[2][at] | right[2][to]) & (left[1][at] != right[1][to])
        held = np.unique(np.append(held, left[1][at[use]] * n + right[1][to[use]]))
        end = np.searchsorted(held, left[1][e] * n) if e < len(upto) else len(held)
        yield held[:end]
        held, s = held[end:], e


def _shortest(i: np.ndarray, j: np.ndarray, d: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `width` nearest of each i, ties to the smaller j."""
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    own = np.arange(len(i)) - np.searchsorted(i, i) < width
    return i[own], j[own], d[own]


def _joined(members: DataFrame, points: DataFrame, parts: int, width: int, metric: str) -> DataFrame:
    """i, j, d: pairs of fellow members, one of them fresh, that are nearer than the end of i's list; the `width` nearest of a pair of blocks.

    A row without i for each pair of blocks has the number of its comparisons as d.
    """

    def run(key: tuple, m: pa.Table, x: pa.Table) -> pa.Table:
        made, out = 0, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if m.num_rows and x.num_rows:
            ids = x.column("u").to_numpy()
            order = np.argsort(ids)
            ids, end = ids[order], x.column("far").to_numpy()[order]
            v = _vectors(x)[order]
            w, own, u, fresh = _entries(m)
            u = np.searchsorted(ids, u)
            p, q = (k.as_py() for k in key)
            left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
            left, right = left[np.argsort(u[left], kind="stable")], right[np.argsort(w[right], kind="stable")]
            sides = (w[left], u[left], fresh[left]), (w[right], u[right], fresh[right])
            del w, own, u, fresh, left, right
            for pairs in _fellows(*sides, len(ids)):
                if p == q:  # within a block each pair comes in both orders
                    pairs = pairs[pairs // len(ids) < pairs % len(ids)]
                made += len(pairs)
                for s in range(0, len(pairs), PAIRS_AT_ONCE):
                    a, b = np.divmod(pairs[s : s + PAIRS_AT_ONCE], len(ids))
                    d = K.exact(v[a], v[b], metric)
                    near = [(i[d < end[i]], j[d < end[i]], d[d < end[i]]) for i, j in ((a, b), (b, a))]
                    out = tuple(np.concatenate(c) for c in zip(out, *near, strict=True))
                    if len(out[0]) > FORMED + width * len(ids):
                        out = _shortest(*out, width)
            i, j, d = _shortest(*out, width)
            out = (ids[i], ids[j], d)
        return _with_count(*out, made)

    keys = ["p", "q"]
    own = F.pmod(F.xxhash64("u"), F.lit(parts)).cast("int")
    placed = points.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    placed = placed.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.col("u").alias("u"), "v", "far")
    return _listed(members, parts).groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(run, "i long, j long, d double")


def neighbour_graph(cells: DataFrame, k: int, metric: str = "euclidean", width: int | None = None, trees: int = 3, leaf: int = 64, change: float = 0.01, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """(i, j, d, rank of the k nearest found; one dict a round with the comparisons made and the list entries changed).

    cells has a whole number cell_id and vec. Distances are exact; ties among what was found go to the smaller j. Rows with a null id, a null, empty or
    non-finite vector (cosine: also zero) take no part; of equal ids the least vector counts; all others are of one length.
    A cell gets k neighbours, or all others where there are fewer. `width` is the length of the lists while they improve (default
    k + 5), more trees and larger leaves cost comparisons and raise the recall.
    """
    width = max(k, width or k + 5)
    rows = stored(usable(cells, metric))
    n, single = rows.agg(F.count(F.lit(1)), F.min(F.forall("v", lambda x: x == x.cast("float").cast("double")))).first()
    if single:  # the same values in half the bytes; tasks compute with doubles
        rows = rows.withColumn("v", F.col("v").cast("array<float>"))
    parts = max(min(BLOCKS, K.blocks(n, BLOCK)), K.blocks(n, K.LARGE))
    nodes, r = forest(rows, trees, leaf, metric, seed)
    found, seen = _counted(_leaf_lists(nodes, leaf, width, metric, seed, r))
    graph = stored(_nearest(found.withColumn("fresh", F.lit(True)), width))
    rounds = [{"compared": int(seen.get["compared"] or 0), "changed": graph.count()}]
    while rounds[-1]["changed"] > change * n * width:
        far = graph.filter(F.col("rank") == width).select(F.col("i").alias("u"), F.col("d").alias("far"))
        points = rows.withColumnRenamed("id", "u").join(far, "u", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
        found, seen = _counted(_joined(_members(graph, width, len(rounds), seed), points, parts, width, metric))
        old = graph.select("i", "j", "d", F.lit(False).alias("fresh"))
        graph = stored(_nearest(old.union(found.withColumn("fresh", F.lit(True))), width))
        rounds.append({"compared": int(seen.get["compared"] or 0), "changed": graph.filter("fresh").count()})
    out = graph.filter(F.col("rank") <= k).select("i", "j", "d", "rank")
    full = out.groupBy("i").count().filter(F.col("count") >= min(k, n - 1)).select(F.col("i").alias("id"))
    short = stored(rows.join(full, "id", "left_anti"))  # alone in every leaf: these ask all rows
    left = short.count()
    if left and n > 1:
        named = lambda df: df.select(F.col("id").alias("cell_id"), F.col("v").cast("array<double>").alias("vec"))
        rest = K.knn(named(short), named(rows), k, metric).select("i", "j", "d", "rank")
        out = out.join(short.select(F.col("id").alias("i")), "i", "left_anti").select("i", "j", "d", "rank").union(rest)
        rounds.append({"compared": left * n, "changed": left * min(k, n - 1)})
    return out, rounds


def approximate_knn(cells: DataFrame, k: int, metric: str = "euclidean", **how) -> DataFrame:
    """i, j, d, rank: the k nearest other cells of each cell, as far as the descent found them (see neighbour_graph)."""
    return neighbour_graph(cells, k, metric, **how)[0]
