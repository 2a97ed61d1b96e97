"""Graphs as edge tables (i, j, weight): the integration graph, components, shortest paths, spanning trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import knn as K
from tessera.operators import match as M
from tessera.operators.stage import shared_folder, stored

#: Sources and nodes of a task that follows paths, edges a node of it, and edges compared at a time.
SOURCES, NODES, EDGES_A_NODE, RELAXED = 64, 1 << 18, 16, 8_192
#: Labels that are spread in one table.
LABELS = 64


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    spark: SparkSession = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def rank_weights(edges: DataFrame) -> DataFrame:
    """i, j, weight: the average rank of the distance among i's edges."""
    w = Window.partitionBy("i").orderBy("d")
    tie = F.count(F.lit(1)).over(Window.partitionBy("i", "d"))
    return edges.withColumn("weight", F.rank().over(w) + (tie - 1) / 2).select("i", "j", "weight")


def neighbour_copy(matches: DataFrame, intra: DataFrame) -> DataFrame:
    """Edges from each matched cell to the neighbours of its partner: i -> n for match (i, j) and edge (j, n)."""
    return matches.select("i", F.col("j").alias("p")).join(intra.select(F.col("i").alias("p"), F.col("j").alias("n"), "weight"), "p").select("i", F.col("n").alias("j"), "weight")


def integrate(cells: DataFrame, k: int = 12, metric: str = "cosine", keep: float = 0.75, adjacency: DataFrame | None = None, hub: str = "csls", hub_k: int = 12) -> DataFrame:
    """The integration graph i, j, weight (directed, without loops).

    Within a batch each cell points to its k nearest (itself takes the first place, as in the metric's definition), weighted
    by rank. Between batches cells are matched one to one, outlying matches are dropped, and each matched cell gets edges
    to its partner (weight 1) and to the partner's neighbours, in both directions. Distances are reduced for hubs by `hub`
    before they are ranked and matched (within a batch over the max(k, hub_k) nearest); kinds that are not local to a pair
    of cells and their scales act within batches only.
    """
    near = K.knn(cells, cells, max(k, hub_k) - 1, metric, ("batch",)).select("i", "j", "d", "batch")
    if hub != "none":
        scale = K.local_scale(near)
        near = K.hubness(near, scale, scale, hub)
    w = Window.partitionBy("i").orderBy("d", "j")
    near = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") < k)
    intra = near.select("i", "j", (F.col("r") + 1).cast("double").alias("weight"))
    loops = cells.select(F.col("cell_id").alias("i"), F.col("cell_id").alias("j"), F.lit(1.0).alias("weight"))
    full = cut(intra.union(loops))
    m = cut(M.outlier_cut(M.matched(cells, adjacency if adjacency is not None else M.stairs(cells), 1, metric, hub=hub if hub in M.HUBNESS else "none", hub_k=hub_k), keep))
    both = m.select("i", "j").union(m.select(F.col("j").alias("i"), F.col("i").alias("j")))
    return full.union(neighbour_copy(both, full)).filter("i <> j").groupBy("i", "j").agg(F.min("weight").alias("weight"))


def components(edges: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """node, component: the smallest node reachable. Labels pass along edges and jump to their label's label."""
    e = cut(edges.select(F.col(i).alias("a"), F.col(j).alias("b")).union(edges.select(F.col(j), F.col(i))).distinct())
    state = cut(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = e.join(state, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        out = state.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = state.select(F.col("node").alias("c"), F.col("component").alias("c2"))
        out = cut(out.join(jump, "c", "left").select("node", "old", F.least("c", F.coalesce("c2", "c")).alias("component")))
        if out.filter("component <> old").isEmpty():
            return out.select("node", "component")
        state = out.select("node", "component")


def _relaxed(d: np.ndarray, start: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, most: float) -> np.ndarray:
    """d (nodes, sources), shortened in place along the edges a -> b (sorted by b) until none gets shorter; start marks the rows that may shorten others."""
    new = start
    while new.any():
        at = np.flatnonzero(new[a])
        new = np.zeros(len(d), bool)
        ends = np.append(np.flatnonzero(np.diff(b[at], prepend=-1)), len(at))  # the edges of one b stay together
        s = 0
        while s < len(ends) - 1:
            t = max(s + 1, int(np.searchsorted(ends, ends[s] + RELAXED, "right")) - 1)
            those = at[ends[s] : ends[t]]
            step = d[a[those]]
            step += weight[those, None]
            step = np.minimum.reduceat(step, ends[s:t] - ends[s], axis=0)
            nodes = b[at[ends[s:t]]]
            shorter = (step < d[nodes]) & (step <= most)
            rows = shorter.any(1)
            d[nodes[rows]] = np.where(shorter[rows], step[rows], d[nodes[rows]])
            new[nodes[rows]] = True
            s = t
    return d


def shortest_paths(edges: DataFrame, sources: DataFrame, most: float | None = None, sources_a_task: int = SOURCES, nodes_a_task: int = NODES) -> DataFrame:
    """source, node, d from each source over undirected weights, none negative (within `most`).

    A task has some of the sources and a block of the nodes with the edges from them, and follows all paths inside of it. Where
    there are several blocks, what got shorter is sent along the edges that leave one, until nothing does. Distances are kept
    as arrays, a number a source.
    """
    limit = float("inf") if most is None else float(most)
    e = stored(edges.select("i", "j", "weight").union(edges.select(F.col("j"), F.col("i"), "weight")).groupBy("i", "j").agg(F.min("weight").cast("double").alias("weight")).filter("i <> j"))
    asked = stored(sources.select(F.col("cell_id").alias("source")).distinct())
    nodes, links, asked_n = e.select("i").distinct().count(), e.count(), asked.count()
    parts = max(1, -(-nodes // nodes_a_task), -(-links // (EDGES_A_NODE * nodes_a_task)))
    groups = max(1, -(-asked_n // sources_a_task))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(parts)).cast("int")
    named = stored(asked.withColumn("s", F.pmod(F.xxhash64("source"), F.lit(groups)).cast("int")).groupBy("s").agg(F.sort_array(F.collect_list("source")).alias("ids")))  # a row a task's sources
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    held = stored(e.select(block("i").alias("p"), block("j").alias("to"), "i", "j", "weight"))
    zero = F.transform("ids", lambda x: F.when(x == F.col("node"), 0.0).otherwise(float("inf")))
    now = named.select("s", "ids", F.explode("ids").alias("node")).select("s", block("node").alias("p"), "node", zero.alias("ds"), F.lit(True).alias("come"))
    kind = "s int, p int, node long, ds array<double>, come boolean"

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows:
            return pa.table({"s": pa.array([], pa.int32()), "p": pa.array([], pa.int32()), "node": pa.array([], pa.int64()), "ds": pa.array([], pa.list_(pa.float64())), "come": pa.array([], pa.bool_())})
        given, come = x.column("node").to_numpy(), x.column("come").to_numpy()
        ds = x.column("ds").combine_chunks().flatten().to_numpy().reshape(len(given), -1)
        i, j, to, weight = (y.column(c).to_numpy() for c in ("i", "j", "to", "weight"))
        s, p = x.column("s")[0].as_py(), x.column("p")[0].as_py()
        inner = to == p
        names = np.unique(np.concatenate([given, i]))
        d = np.full((len(names), ds.shape[1]), np.inf)
        d[np.searchsorted(names, given[~come])] = ds[~come]
        before = d.copy() if parts > 1 else None
        start = np.zeros(len(names), bool)
        if come.any():
            at = np.searchsorted(names, given[come])
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            least, at = np.minimum.reduceat(ds[come][order], first, axis=0), at[order][first]
            start[at] = (least < d[at]).any(1)
            d[at] = np.minimum(d[at], least)
        a, b = np.searchsorted(names, i[inner]), np.searchsorted(names, j[inner])
        order = np.argsort(b, kind="stable")
        d = _relaxed(d, start, a[order], b[order], weight[inner][order], limit)
        reached = np.isfinite(d).any(1)
        out = [(np.full(reached.sum(), p, np.int32), names[reached], d[reached], np.zeros(reached.sum(), bool))]
        if parts > 1 and not inner.all():
            better = d < before
            a, target, block_, w = np.searchsorted(names, i[~inner]), j[~inner], to[~inner], weight[~inner]
            leave = better[a].any(1)
            order = np.flatnonzero(leave)[np.argsort(target[leave], kind="stable")]
            ends = np.append(np.flatnonzero(np.diff(target[order], prepend=target[order][:1] - 1)), len(order))
            for f in range(0, len(ends) - 1, RELAXED // 16):  # some targets at a time, so that what is held stays small
                some = ends[f : f + RELAXED // 16 + 1]
                those = order[some[0] : some[-1]]
                step = np.where(better[a[those]], d[a[those]] + w[those, None], np.inf)
                step = np.minimum.reduceat(step, some[:-1] - some[0], axis=0)
                step[step > limit] = np.inf
                sent = np.isfinite(step).any(1)
                out.append((block_[order[some[:-1]]][sent].astype(np.int32), target[order[some[:-1]]][sent], step[sent], np.ones(sent.sum(), bool)))
        p_, node, d, come = (np.concatenate(c) for c in zip(*out, strict=True))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
        return pa.table({"s": pa.array(np.full(len(d), s, np.int32)), "p": pa.array(p_), "node": pa.array(node, pa.int64()), "ds": lists, "come": pa.array(come)})

    linked = held.withColumn("s", every)
    while True:
        now = stored(now.groupBy("s", "p").cogroup(linked.groupBy("s", "p")).applyInArrow(run, kind))
        if parts == 1 or now.filter("come").isEmpty():
            found = now.join(F.broadcast(named), "s").select("node", F.explode(F.arrays_zip("ids", "ds")).alias("x"))
            return found.select(F.col("x.ids").alias("source"), "node", F.col("x.ds").alias("d")).filter(F.col("d") < float("inf"))


def _nearest_outside(asked: DataFrame, cells: DataFrame, metric: str) -> DataFrame:
    """batch, comp, e: the shortest edge (d, lo, hi, far) from the asked cells of each component to a cell outside of it.

    Both sides have cell_id, vec, batch and comp. A pair of blocks is one task's work and gives a row a component at most.
    """
    sides = [df.select(F.col("cell_id").alias("id"), F.col("vec").alias("v"), "batch", "comp") for df in (asked, cells)]
    na, nb = (K.blocks(s.groupBy("batch").count().agg(F.max("count")).first()[0] or 0) for s in sides)
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = sides[0].withColumn("p", dealt(na)).withColumn("q", every(nb))
    b = sides[1].withColumn("q", dealt(nb)).withColumn("p", every(na))
    kind = cells.schema["batch"].dataType.simpleString()

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        rows = []
        if x.num_rows and y.num_rows:
            (vx, ix, cx), (vy, iy, cy) = ((np.stack(t.column("v").to_numpy()), t.column("id").to_numpy(), t.column("comp").to_numpy()) for t in (x, y))
            i, j, d = K.best(vx, ix, vy, iy, 1, metric, False, (cx, cy))
            own, far = dict(zip(ix.tolist(), cx.tolist(), strict=True)), dict(zip(iy.tolist(), cy.tolist(), strict=True))
            least: dict = {}
            for u, v, w in zip(i.tolist(), j.tolist(), d.tolist(), strict=True):
                e = (w, min(u, v), max(u, v), far[v])
                if own[u] not in least or e < least[own[u]]:
                    least[own[u]] = e
            rows = [(c, *e) for c, e in least.items()]
        t = x if x.num_rows else y
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({"batch": pa.array([t.column("batch")[0].as_py()] * len(rows), t.schema.field("batch").type), **{n: pa.array(c, k) for n, c, k in zip(("comp", "d", "lo", "hi", "far"), columns, kinds, strict=True)}})

    found = a.groupBy("batch", "p", "q").cogroup(b.groupBy("batch", "p", "q")).applyInArrow(run, f"batch {kind}, comp long, d double, lo long, hi long, far long")
    return found.select("batch", "comp", F.struct("d", "lo", "hi", "far").alias("e"))


def _contracted(choice: DataFrame) -> DataFrame:
    """comp, root from comp and the component it chose: two that chose each other are led by the smaller, the rest follow."""
    back = choice.select(F.col("comp").alias("far"), F.col("far").alias("back"))
    leads = (F.col("back") == F.col("comp")) & (F.col("comp") < F.col("far"))
    now = stored(choice.join(back, "far").select("comp", F.when(leads, F.col("comp")).otherwise(F.col("far")).alias("root")))
    while True:  # pointers jump to their pointer's pointer
        further = now.select(F.col("comp").alias("root"), F.col("root").alias("next"))
        jumped = stored(now.join(further, "root").select("comp", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        if jumped.filter("moved").isEmpty():
            return jumped.select("comp", "root")
        now = jumped.select("comp", "root")


def hung(tree: DataFrame) -> DataFrame:
    """i, j, d of trees (batch, i, j, d) turned so that every j hangs below its i, the smallest id of the batch being the root.

    The tour around a tree passes every edge twice; an arc's place in it is found by jumping along the tour, in as many rounds as
    the logarithm of its length. The arc that comes first leads down.
    """
    arcs = tree.select("batch", F.col("i").alias("u"), F.col("j").alias("v"), "d").union(tree.select("batch", F.col("j").alias("u"), F.col("i").alias("v"), "d"))
    around = Window.partitionBy("v").orderBy("u")  # the neighbours of a cell
    turn = F.coalesce(F.lead("u").over(around), F.min("u").over(Window.partitionBy("v")))
    root = tree.groupBy("batch").agg(F.least(F.min("i"), F.min("j")).alias("root"))
    start = arcs.join(root, "batch").filter("u = root").groupBy("batch").agg(F.min(F.struct("u", "v")).alias("s")).select("batch", F.col("s.u").alias("su"), F.col("s.v").alias("sv"))
    step = arcs.withColumn("turn", turn).join(start, "batch").select("u", "v", "d", F.when(~((F.col("v") == F.col("su")) & (F.col("turn") == F.col("sv"))), F.struct(F.col("v").alias("u"), F.col("turn").alias("v"))).alias("next"))
    now = stored(step.withColumn("left", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long")))
    while not now.filter("next is not null").isEmpty():
        on = now.select(F.struct("u", "v").alias("next"), F.col("next").alias("further"), F.col("left").alias("more"))
        done = now.filter("next is null")
        now = stored(done.unionByName(now.filter("next is not null").join(on, "next").select("u", "v", "d", F.col("further").alias("next"), (F.col("left") + F.col("more")).alias("left"))))
    back = now.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("left").alias("other"))
    return now.join(back, ["u", "v"]).filter("left > other").select(F.col("u").alias("i"), F.col("v").alias("j"), "d")


def spanning_trees(cells: DataFrame, metric: str = "euclidean", max_batch: int | None = None, k: int = 12, rooted: bool = True) -> DataFrame:
    """i, j, d: the minimum spanning tree of each batch, exact, by Boruvka's rounds; rooted: j hangs below i (see hung), else i < j.

    In a round every component takes its shortest edge to another one (ties by the two ids, so that edges have one order
    and no circle can form) and components joined by such edges become one; their number halves at least. A cell's k
    nearest, found once, answer for it as long as one of them lies outside of its component. A cell without such a
    neighbour cannot have an edge shorter than its k-th distance, so it is asked again, by a blocked join against all cells
    of its batch, only where its component has found nothing shorter than that. A caller who wants an error for batches
    beyond some size gives max_batch.
    """
    if max_batch is not None and (n := cells.groupBy("batch").count().agg(F.max("count")).first()[0] or 0) > max_batch:
        raise ValueError(f"a batch of {n} cells is beyond the size asked for ({max_batch}); subsample first")
    own = cells.select("cell_id", "batch", "vec")
    near = stored(K.knn(own, own, k, metric, ("batch",)))
    reach = near.groupBy("i").agg(F.max("d").alias("reach"), F.count(F.lit(1)).alias("n")).select(F.col("i").alias("cell_id"), F.when(F.col("n") < k, float("inf")).otherwise(F.col("reach")).alias("reach"))
    reach = stored(reach)
    comp = stored(own.select("cell_id", "batch", F.col("cell_id").alias("comp")))
    open_ = near.select("batch", "i", "j", "d", F.col("i").alias("ci"), F.col("j").alias("cj"))
    tree = None
    while True:
        edge = F.struct("d", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.col("cj").alias("far"))
        listed = stored(open_.groupBy("batch", F.col("ci").alias("comp")).agg(F.min(edge).alias("e")))
        shut = comp.join(open_.select(F.col("i").alias("cell_id")).distinct(), "cell_id", "left_anti").join(reach, "cell_id")
        asked = shut.join(listed.select("comp", F.col("e.d").alias("d")), "comp", "left").filter("d is null or reach <= d").join(own.select("cell_id", "vec"), "cell_id")
        asked = stored(asked.filter(F.col("reach") < float("inf")).select("cell_id", "vec", "batch", "comp"))
        found = listed
        if not asked.isEmpty():
            found = found.union(_nearest_outside(asked, own.join(comp.select("cell_id", "comp"), "cell_id"), metric))
        best = stored(found.groupBy("batch", "comp").agg(F.min("e").alias("e")).select("batch", "comp", "e.*"))
        if best.isEmpty():
            tree = tree if tree is not None else best.select("batch", F.col("lo").alias("i"), F.col("hi").alias("j"), "d")
            return hung(tree) if rooted else tree.select("i", "j", "d")
        chosen = best.select("batch", F.col("lo").alias("i"), F.col("hi").alias("j"), "d").distinct()
        tree = chosen if tree is None else tree.union(chosen)
        root = stored(_contracted(best.select("comp", "far")))
        comp = stored(comp.join(root, "comp").select("cell_id", "batch", F.col("root").alias("comp")))
        ci, cj = (root.select(F.col("comp").alias(c), F.col("root").alias(f"r{c}")) for c in ("ci", "cj"))
        open_ = stored(open_.join(ci, "ci").join(cj, "cj").filter("rci <> rcj").select("batch", "i", "j", "d", F.col("rci").alias("ci"), F.col("rcj").alias("cj")))


def linear_assignment_integrate(cells: DataFrame, intra: int = 15, rounds: int = 1, keep: float = 0.75, scaling: float = 0.25, scale_k: int = 2, adjacency: DataFrame | None = None) -> DataFrame:
    """i, j, weight, symmetric: per batch the larger of the k-nearest graph and the spanning tree, between batches scaled matches."""
    near = K.knn(cells, cells, max(intra, scale_k), "euclidean", ("batch",))
    inside = K.symmetric(near.filter(F.col("rank") <= intra).select("i", "j", "d").union(spanning_trees(cells, rooted=False))).withColumnRenamed("d", "weight")
    scale = K.local_scale(near.filter(F.col("rank") <= scale_k))
    m = M.scaled(M.matched(cells, adjacency if adjacency is not None else M.stairs(cells), rounds), scale, keep, scaling).filter("weight > 0")
    between = m.select("i", "j", "weight").union(m.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight"))
    return inside.union(between.groupBy("i", "j").agg(F.min("weight").alias("weight")))


def two_hops(edges: DataFrame) -> DataFrame:
    """Pairs reachable in two steps but not in one: i, j."""
    e = edges.select("i", "j").distinct()
    far = e.alias("x").join(e.alias("y"), F.col("x.j") == F.col("y.i")).select(F.col("x.i").alias("i"), F.col("y.j").alias("j")).filter("i <> j").distinct()
    return far.join(e, ["i", "j"], "left_anti")


def neighbour_lists(edges: DataFrame, k: int) -> DataFrame:
    """i, neighbours, weights: arrays of the k lightest edges, shorter ones as they are."""
    w = Window.partitionBy("i").orderBy("weight", "j")
    top = edges.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    out = top.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("r", "j", "weight"))).alias("l"))
    return out.select("i", F.col("l.j").alias("neighbours"), F.col("l.weight").alias("weights"))


def gaussian(edges: DataFrame, factor: float = 1.0) -> DataFrame:
    """i, j, weight = exp(-d / sigma); sigma is the mean of the rows' least distances times factor."""
    edges = stored(edges.select("i", "j", "d"))  # found once, read twice
    sigma = edges.filter("d > 0").groupBy("i").agg(F.min("d").alias("m")).agg((F.avg("m") * factor).alias("sigma"))
    return edges.crossJoin(F.broadcast(sigma)).select("i", "j", F.exp(-F.col("d") / F.col("sigma")).alias("weight"))  # sigma: one row


def spread_labels(edges: DataFrame, labels: DataFrame, alpha: float = 0.2, rounds: int = 30, clamp: bool = False) -> DataFrame:
    """cell_id, label, score: labels spread over weighted edges: F <- alpha S F + (1 - alpha) Y, S = D^-1/2 W D^-1/2.

    labels has cell_id and label, null where it is to be predicted. With clamp, known labels stay as they are (label
    propagation) and S = D^-1 W.
    """
    w = stored(edges.select("i", "j", "weight").filter("i <> j and weight > 0"))
    degree = stored(w.groupBy("i").agg(F.sum("weight").alias("g")))
    dj = degree.select(F.col("i").alias("j"), F.col("g").alias("h"))
    share = F.col("weight") / (F.col("g") if clamp else F.sqrt(F.col("g") * F.col("h")))
    s = stored(w.join(degree, "i").join(dj, "j").select("i", "j", share.alias("s")))
    known = labels.filter("label is not null")
    names = [r["label"] for r in known.select("label").distinct().orderBy("label").collect()]  # a row a label
    out = labels.sparkSession.createDataFrame([], f"cell_id {labels.schema['cell_id'].dataType.simpleString()}, label {labels.schema['label'].dataType.simpleString()}, f double")
    for at in range(0, len(names), LABELS):  # a column a label: labels do not act on each other
        some = names[at : at + LABELS]
        columns = [f"f{k}" for k in range(len(some))]
        y = stored(known.groupBy("cell_id").agg(*[F.sum(F.when(F.col("label") == x, 1.0)).alias(c) for x, c in zip(some, columns, strict=True)]))
        f = y
        for _ in range(rounds):
            got = s.join(f.withColumnRenamed("cell_id", "j"), "j").groupBy(F.col("i").alias("cell_id")).agg(*[F.sum(F.col("s") * F.col(c)).alias(c) for c in columns])
            if clamp:
                f = got.join(y.select("cell_id"), "cell_id", "left_anti").unionByName(y)
            else:
                both = got.select("cell_id", *[(F.col(c) * alpha).alias(c) for c in columns]).unionByName(y.select("cell_id", *[(F.col(c) * (1 - alpha)).alias(c) for c in columns]))
                f = both.groupBy("cell_id").agg(*[F.sum(c).alias(c) for c in columns])
            f = stored(f)
        each = F.array(*[F.struct(F.lit(x).cast(labels.schema["label"].dataType).alias("label"), F.col(c).alias("f")) for x, c in zip(some, columns, strict=True)])
        out = out.union(f.select("cell_id", F.explode(each).alias("x")).select("cell_id", "x.label", "x.f").filter("f is not null"))
    top = Window.partitionBy("cell_id").orderBy(F.desc("f"), "label")
    return out.withColumn("r", F.row_number().over(top)).filter("r = 1").select("cell_id", "label", F.col("f").alias("score"))
