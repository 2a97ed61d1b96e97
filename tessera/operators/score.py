"""Evaluation: neighbourhood agreement, silhouette, kNI, cross-validation, Rand index, Pareto front and tables."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vectors import average_rank, gmean
from tessera.operators import knn as K
from tessera.operators.stage import stored


def label_agreement(cells: DataFrame, k: int = 5, on: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """agreement: share of (cell, neighbour) pairs of one label (a group `by` at a time)."""
    near = K.knn(cells, cells, k, "euclidean", by)
    one = cells.dropDuplicates(["cell_id"])  # a cell may stand in several groups
    own = one.select(F.col("cell_id").alias("i"), F.col(on).alias("a"))
    other = one.select(F.col("cell_id").alias("j"), F.col(on).alias("b"))
    return near.join(own, "i").join(other, "j").groupBy(*by).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("agreement"))


def label_agreements(cells: DataFrame, ks: tuple[int, ...], on: str = "label") -> DataFrame:
    """k, score: label_agreement for each k, from one search for the largest."""
    near = K.knn(cells, cells, max(ks), "euclidean").select("i", "j", "rank")
    one = cells.dropDuplicates(["cell_id"])
    own, other = (one.select(F.col("cell_id").alias(c), F.col(on).alias(f"l{c}")) for c in ("i", "j"))
    same = near.join(own, "i").join(other, "j").groupBy("rank").agg(F.sum((F.col("li") == F.col("lj")).cast("long")).alias("same"), F.count(F.col("li") == F.col("lj")).alias("n"))
    asked = same.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("rank <= k")
    return asked.groupBy("k").agg((F.sum("same") / F.sum("n")).alias("score"))


def agreements_on(cells: DataFrame, ons: tuple[str, ...], k: int = 5) -> DataFrame:
    """A column for each of `ons` with its label_agreement, from one search."""
    near = K.knn(cells, cells, k, "euclidean").select("i", "j")
    one = cells.dropDuplicates(["cell_id"])
    own, other = (one.select(F.col("cell_id").alias(c), *[F.col(on).alias(f"{c}_{on}") for on in ons]) for c in ("i", "j"))
    return near.join(own, "i").join(other, "j").agg(*[F.avg((F.col(f"i_{on}") == F.col(f"j_{on}")).cast("double")).alias(on) for on in ons])


def silhouette(cells: DataFrame, on: str = "label") -> DataFrame:
    """silhouette: mean of (b - a) / max(a, b) with exact mean distances to each label's cells.

    Mean Euclidean distances have no closed form, so all pairs are taken, in blocks (see `knn`); for each block and label one
    number a cell comes back.
    """
    import numpy as np
    import pyarrow as pa

    n = K.blocks(cells.count())
    kind = cells.schema[on].dataType.simpleString()
    side = cells.select(F.col("cell_id").alias("id"), "vec", F.col(on).alias("label"))
    a = side.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    b = side.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        out: dict = {"id": [], "own": [], "label": [], "s": [], "n": []}
        if x.num_rows and y.num_rows:
            vx, vy = (np.stack(t.column("vec").to_numpy()) for t in (x, y))
            lx, ly = x.column("label").to_pylist(), np.array(y.column("label").to_pylist(), object)
            names = sorted(set(ly.tolist()), key=str)
            member = np.stack([ly == lab for lab in names], 1).astype(float)
            step = max(1, K.HELD // len(vy))  # some rows at a time, so that what is held stays small
            sums = np.concatenate([K.close(vx[s : s + step], vy) @ member for s in range(0, len(vx), step)])
            for g, lab in enumerate(names):
                out["id"] += x.column("id").to_pylist()
                out["own"] += lx
                out["label"] += [lab] * len(lx)
                out["s"] += sums[:, g].tolist()
                out["n"] += [int(member[:, g].sum())] * len(lx)
        t = x.schema.field("label").type
        return pa.table({"id": pa.array(out["id"], pa.int64()), "own": pa.array(out["own"], t), "label": pa.array(out["label"], t), "s": pa.array(out["s"], pa.float64()), "n": pa.array(out["n"], pa.int64())})

    sums = a.groupBy("p", "q").cogroup(b.groupBy("p", "q")).applyInArrow(run, f"id long, own {kind}, label {kind}, s double, n long")
    mean = sums.groupBy("id", "own", "label").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    inside = F.max(F.when(F.col("own") == F.col("label"), F.when(F.col("n") > 1, F.col("s") / (F.col("n") - 1))))
    outside = F.min(F.when(F.col("own") != F.col("label"), F.col("s") / F.col("n")))
    each = mean.groupBy("id").agg(inside.alias("a"), outside.alias("b"))
    return each.agg(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


def robust_scaled(cells: DataFrame) -> DataFrame:
    """cells whose vector components are scaled by mean and interquartile range (0 as 1), from one row of statistics."""
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.75)))
    each = cells.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), q.alias("q"))
    width = F.col("q")[1] - F.col("q")[0]
    one = each.agg(F.sort_array(F.collect_list(F.struct("dim", "m", F.when(width == 0, 1.0).otherwise(width).alias("w")))).alias("__s"))
    return cells.crossJoin(F.broadcast(one)).withColumn("vec", F.zip_with("vec", "__s", lambda x, s: (x - s["m"]) / s["w"])).drop("__s")


def kni(cells: DataFrame, k: int = 10, most: float = 0.8) -> DataFrame:
    """cell_id, batch, label, same, diverse, vote, vote_other for each cell.

    Vectors are scaled robustly first, and a missing label is the label "Unknown". The cell counts as its own first
    neighbour; `same` of k lie in its batch; it is diverse where that is under most * k; votes are the commonest label of all
    neighbours and of those of other batches, the smallest on ties.
    """
    cells = robust_scaled(cells).withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("Unknown")))
    near = K.knn(cells, cells, k, "euclidean", self_too=True)
    own = cells.select(F.col("cell_id").alias("i"), "batch", "label")
    other = cells.select(F.col("cell_id").alias("j"), F.col("batch").alias("bj"), F.col("label").alias("lj"))
    x = near.join(own, "i").join(other, "j")
    same = F.sum((F.col("batch") == F.col("bj")).cast("int"))
    out = x.groupBy(F.col("i").alias("cell_id"), "batch", "label").agg(same.alias("same"), F.mode("lj", True).alias("vote"), F.mode(F.when(F.col("batch") != F.col("bj"), F.col("lj")), True).alias("vote_other"))
    return out.withColumn("diverse", F.col("same") < most * k)


def kni_by_batch(votes: DataFrame) -> DataFrame:
    """batch, acc, kni, diverse, same: shares and the mean number of neighbours of the own batch."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return votes.groupBy("batch").agg(share(F.col("vote") == F.col("label")).alias("acc"), share(F.col("diverse") & (F.col("vote_other") == F.col("label"))).alias("kni"), share(F.col("diverse")).alias("diverse"), F.avg("same").alias("same"))


def kni_status(votes: DataFrame) -> DataFrame:
    """cell_id, status: low diversity, wrong or correct (the table behind the plot)."""
    return votes.select("cell_id", F.when(~F.col("diverse"), "low diversity").when(F.col("vote_other") == F.col("label"), "correct").otherwise("wrong").alias("status"))


def confusion(pairs: DataFrame, a: str, b: str, full: bool = False) -> DataFrame:
    """a, b, n, dice = 2 n / (n_a + n_b); with `full` zero cells of all labels too."""
    n = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    if full:
        labels = n.select("a").union(n.select("b")).distinct()
        n = labels.join(labels.withColumnRenamed("a", "b")).join(n, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # few labels
    dice = 2 * F.col("n") / (F.sum("n").over(Window.partitionBy("a")) + F.sum("n").over(Window.partitionBy("b")))
    return n.withColumn("dice", dice)


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """ari of two labellings, from the sums of their contingency table."""
    c2 = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    n = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    sums = n.agg(c2("n").alias("nij"), F.sum("n").alias("total"))
    sa = n.groupBy(a).agg(F.sum("n").alias("n")).agg(c2("n").alias("na"))
    sb = n.groupBy(b).agg(F.sum("n").alias("n")).agg(c2("n").alias("nb"))
    expected = F.col("na") * F.col("nb") / (F.col("total") * (F.col("total") - 1) / 2)
    most = (F.col("na") + F.col("nb")) / 2
    return sums.crossJoin(sa).crossJoin(sb).select(F.when(most == expected, 1.0).otherwise((F.col("nij") - expected) / (most - expected)).alias("ari"))


def adjusted_rand_by(pairs: DataFrame, a: str, b: str, by: str = "batch") -> DataFrame:
    """by, ari: adjusted_rand within each group, all groups in one pass of contingency tables; rows without either label do not count."""
    n = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by, a, b).agg(F.count("*").alias("n"))
    c2 = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    out = n.groupBy(by).agg(c2("n").alias("nij"), F.sum("n").alias("total"))
    for c, name in ((a, "na"), (b, "nb")):
        side = n.groupBy(F.col(by).alias("__by"), c).agg(F.sum("n").alias("n")).groupBy("__by").agg(c2("n").alias(name))
        out = out.join(side, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    expected = F.col("na") * F.col("nb") / F.greatest(F.col("total") * (F.col("total") - 1) / 2, F.lit(1.0))
    most = (F.col("na") + F.col("nb")) / 2
    return out.select(by, F.when(most == expected, 1.0).otherwise((F.col("nij") - expected) / (most - expected)).alias("ari"))


def normalized_mutual_information(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """nmi (arithmetic mean of the entropies)."""
    n = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    x = n.withColumns({"t": F.sum("n").over(every), "na": F.sum("n").over(Window.partitionBy(a)), "nb": F.sum("n").over(Window.partitionBy(b))})
    mi = F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb"))))
    h = lambda c: -F.sum(F.col("n") / F.col("t") * F.log(F.col(c) / F.col("t")))
    return x.agg(mi.alias("mi"), h("na").alias("ha"), h("nb").alias("hb")).select(F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"))


def folded(cells: DataFrame, on: str = "label", folds: int = 5) -> DataFrame:
    """cells with `fold`: position in the order of label and id, modulo folds (numbered within each label)."""
    r = F.row_number().over(Window.partitionBy(on).orderBy("cell_id"))
    return cells.withColumn("fold", ((r - 1) % folds).cast("int"))


def knn_cross_validation(cells: DataFrame, on: str = "label", folds: int = 5, k: int = 5, split: str | None = None, invert: bool = False, among: DataFrame | None = None) -> DataFrame:
    """mean, std (population) over the folds of the balanced accuracy of k-nearest votes; folds are batches with `split`.

    among: the nearest cells of each cell, whatever their folds (i, j, d), so that several validations share one search; who
    has fewer than k of other folds there is asked again, so the result is the same.
    """
    base = cells.withColumn("fold", F.col(split)) if split else folded(cells, on, folds)
    names = base.select(F.col("fold").alias("fold_t")).distinct()
    ask = base.select("cell_id", "vec", F.col("fold").alias("f"))
    know = base.select("cell_id", "vec", F.col("fold").alias("own")).join(names, F.col("own") != F.col("fold_t")).select("cell_id", "vec", F.col("fold_t").alias("f"))
    if among is None:
        near = K.knn(ask, know, k, "euclidean", ("f",))
    else:
        fold = base.select("cell_id", "fold")
        near = among.join(fold.select(F.col("cell_id").alias("i"), F.col("fold").alias("f")), "i").join(fold.select(F.col("cell_id").alias("j"), F.col("fold").alias("own")), "j").filter("f <> own")
        near = stored(near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).filter(F.col("rank") <= k).select("i", "j", "d", "f"))
        short = stored(ask.join(near.groupBy(F.col("i").alias("cell_id")).count().filter(F.col("count") >= k), "cell_id", "left_anti").select(ask.columns))
        if not short.isEmpty():
            near = near.join(short.select(F.col("cell_id").alias("i")), "i", "left_anti").unionByName(K.knn(short, know, k, "euclidean", ("f",)).select("i", "j", "d", "f"))
    vote = near.join(base.select(F.col("cell_id").alias("j"), F.col(on).alias("lj")), "j").groupBy("i", "f").agg(F.mode("lj", True).alias("vote"))
    right = vote.join(base.select(F.col("cell_id").alias("i"), F.col(on).alias("y")), "i").groupBy("f", "y").agg(F.avg((F.col("vote") == F.col("y")).cast("double")).alias("recall"))
    each = right.groupBy("f").agg(F.avg("recall").alias("s"))
    s = 1 - F.col("s") if invert else F.col("s")
    return each.agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"))


def pareto_front(scores: DataFrame, key: tuple[str, ...], values: tuple[str, ...], minimise: bool = False) -> DataFrame:
    """Rows that no other row of the same key dominates (as good in all values, better in one)."""
    a, b = scores.alias("a"), scores.alias("b")
    no_worse = better = None
    for v in values:
        x, y = (F.col(f"b.{v}"), F.col(f"a.{v}")) if not minimise else (F.col(f"a.{v}"), F.col(f"b.{v}"))
        no_worse = (x >= y) if no_worse is None else no_worse & (x >= y)
        better = (x > y) if better is None else better | (x > y)
    on = no_worse & better
    for c in key:
        on = on & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, on, "left_anti")


def mean_rank(scores: DataFrame, group: str, name: str, value: Column, descending: bool = True) -> DataFrame:
    """name, rank: average rank of each name within the groups, averaged over the groups."""
    return scores.withColumn("r", average_rank(value, group, descending=descending)).groupBy(name).agg(F.avg("r").alias("rank"))


def results_table(scores: DataFrame, timeseries: DataFrame) -> DataFrame:
    """method, part (TS, Batch or Total), label, batch, both: geometric means over the datasets of each part."""
    x = scores.join(timeseries, "dataset").withColumn("part", F.when(F.col("is_timeseries"), "TS").otherwise("Batch"))
    agg = (gmean("label_mean").alias("label"), gmean("batch_mean").alias("batch"))
    parts = x.groupBy("method", "part").agg(*agg).union(x.groupBy("method").agg(*agg).select("method", F.lit("Total"), "label", "batch"))
    return parts.withColumn("both", F.sqrt(F.col("label") * F.col("batch")))


def pareto_sample(stats: DataFrame, draws: int = 1000, seed: int = 3) -> DataFrame:
    """method, rank: normal draws of (label, batch) for each method; mean rank by the number of draws that dominate."""
    d = stats.join(stats.sparkSession.range(draws).withColumnRenamed("id", "draw"))
    d = d.select("method", "draw", (F.col("label_mean") + F.randn(seed) * F.col("label_std")).alias("x"), (F.col("batch_mean") + F.randn(seed + 1) * F.col("batch_std")).alias("y"))
    b = d.select("draw", F.col("method").alias("m2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    lost = d.join(b, "draw").groupBy("draw", "method").agg(F.sum(((F.col("x2") > F.col("x")) & (F.col("y2") > F.col("y"))).cast("int")).alias("lost"))
    return mean_rank(lost, "draw", "method", F.col("lost"), descending=False)


def friedman(scores: DataFrame, value: str) -> DataFrame:
    """chi2 of the Friedman test of methods over datasets, from mean ranks."""
    r = scores.withColumn("r", average_rank(F.col(value), "dataset"))
    n = scores.agg(F.countDistinct("dataset").alias("n"), F.countDistinct("method").alias("k"))
    m = r.groupBy("method").agg(F.avg("r").alias("m"))
    s = m.agg(F.sum(F.col("m") * F.col("m")).alias("s"))
    return s.crossJoin(n).select((12 * F.col("n") / (F.col("k") * (F.col("k") + 1)) * (F.col("s") - F.col("k") * (F.col("k") + 1) * (F.col("k") + 1) / 4)).alias("chi2"))


def flow_prune(pairs: DataFrame, threshold: float = 0.2, left: int = 1, right: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """by, a, b, n: counts of pairs that matter: over a share of a's flow, or among the largest of a or of b; every node keeps one."""
    n = pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    wa, wb = Window.partitionBy(*by, "a"), Window.partitionBy(*by, "b")
    x = n.withColumns({"out": F.sum("n").over(wa), "ra": F.row_number().over(wa.orderBy(F.desc("n"), "b")), "rb": F.row_number().over(wb.orderBy(F.desc("n"), "a"))})
    keep = (F.col("n") > threshold * F.col("out")) | (F.col("ra") <= left) | (F.col("rb") <= right)
    first = x.filter(keep)
    more_a = x.filter("ra = 1").join(first.select(*by, "a").distinct(), [*by, "a"], "left_anti").select(*x.columns)
    more_b = x.filter("rb = 1").join(first.select(*by, "b").distinct(), [*by, "b"], "left_anti").select(*x.columns)
    return first.union(more_a).union(more_b).select(*by, "a", "b", "n").distinct()


def sankey(aligned: DataFrame, threshold: float = 0.1, left: int = 0, right: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes: node, label, batch; links: source, target, value) between consecutive batches of aligned cells.

    aligned has batch (whole numbers in steps of one), position and label: cells of one position belong together. Links are
    pruned batch by batch (flow_prune), nodes are those of the links, numbered by label and batch. Cells without a label, and
    positions that the next batch lacks, count for nothing.
    """
    at = aligned.filter("label is not null").select("batch", "position", F.col("label").cast("string").alias("a"))
    nxt = at.select((F.col("batch") - 1).alias("batch"), F.col("position").alias("position"), F.col("a").alias("b"))
    kept = stored(flow_prune(at.join(nxt, ["batch", "position"]), threshold, left, right, ("batch",)))
    ends = kept.select(F.col("a").alias("label"), "batch").union(kept.select("b", F.col("batch") + 1)).distinct()
    nodes = ends.withColumn("node", F.row_number().over(Window.orderBy("label", "batch")) - 1).select("node", "label", "batch")  # labels times batches: few
    source = nodes.select(F.col("node").alias("source"), F.col("label").alias("a"), F.col("batch").alias("batch"))
    target = nodes.select(F.col("node").alias("target"), F.col("label").alias("b"), (F.col("batch") - 1).alias("batch"))
    return nodes, kept.join(source, ["batch", "a"]).join(target, ["batch", "b"]).select("source", "target", F.col("n").alias("value"))


# ---- how well a similarity matrix follows an order ----


def _placed(sim: DataFrame) -> DataFrame:
    """i, j, value of a similarity table (a, b, value) by the positions of its nodes in their order (nodes are batches: few)."""
    sim = stored(sim.select("a", "b", "value"))
    at = sim.select(F.col("a").alias("node")).union(sim.select("b")).distinct().withColumn("at", F.row_number().over(Window.orderBy("node")) - 1)
    i, j = at.select(F.col("node").alias("a"), F.col("at").alias("i")), at.select(F.col("node").alias("b"), F.col("at").alias("j"))
    return sim.join(i, "a").join(j, "b").select("i", "j", "value")


def side_spearman(sim: DataFrame) -> DataFrame:
    """score: mean over rows and both sides of the diagonal (itself included) of the rank correlation of value and gap."""
    m = _placed(sim).withColumn("gap", F.abs(F.col("i") - F.col("j")))
    sides = m.filter("j >= i").withColumn("side", F.lit(1)).union(m.filter("j <= i").withColumn("side", F.lit(0)))
    ranked = sides.withColumns({"x": average_rank(F.col("value"), "i", "side"), "y": average_rank(F.col("gap"), "i", "side")})
    rho = ranked.groupBy("i", "side").agg(F.corr("x", "y").alias("rho"), F.count(F.lit(1)).alias("n"))
    return rho.filter("n > 1").agg(F.avg("rho").alias("score"))


def upper_spearman(sim: DataFrame) -> DataFrame:
    """score: the rank correlation of value and gap over all pairs above the diagonal."""
    m = _placed(sim).filter("i < j").withColumn("gap", F.col("j") - F.col("i"))
    return m.withColumns({"x": average_rank(F.col("value")), "y": average_rank(F.col("gap"))}).agg(F.corr("x", "y").alias("score"))


def monotone_triangles(sim: DataFrame) -> DataFrame:
    """share, error: for pairs at least two apart, how many are less similar than both their neighbours towards the diagonal,
    and by how much one neighbour rises where not both do."""
    m = _placed(sim)
    down, left = m.select((F.col("i") - 1).alias("i"), "j", F.col("value").alias("down")), m.select("i", (F.col("j") + 1).alias("j"), F.col("value").alias("left"))
    t = m.filter("j - i >= 2").join(down, ["i", "j"]).join(left, ["i", "j"])
    d, e = F.col("down") - F.col("value"), F.col("left") - F.col("value")
    good = (d > 0) & (e > 0)
    rise = F.when(good, 0.0).otherwise(F.greatest(d, F.lit(0.0)) + F.greatest(e, F.lit(0.0)))
    return t.agg(F.avg(good.cast("double")).alias("share"), F.sum(rise).alias("error"))


def order_pearson(sim: DataFrame) -> DataFrame:
    """score: correlation of the place by value (most similar first on the right, last on the left) and the place by position."""
    m = _placed(sim)
    last = m.agg(F.max("i").alias("last"))
    m = m.join(F.broadcast(last)).filter("i < last and i <> j")  # one row
    right = m.filter("j > i").withColumn("x", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("value"), "j")) - 1).withColumn("y", F.col("j") - F.col("i") - 1)
    left = m.filter("j < i").withColumn("x", F.row_number().over(Window.partitionBy("i").orderBy("value", "j")) - 1).withColumn("y", F.col("j"))
    return right.select("x", "y").union(left.select("x", "y")).agg(F.corr(F.col("x").cast("double"), F.col("y").cast("double")).alias("score"))


# ---- search over parameters ----


def agreement_grid(cells: DataFrame, points: DataFrame) -> DataFrame:
    """point, score: label agreement among the k nearest for every parameter point (point, k, metric), from one search a metric."""
    out = None
    for r in points.groupBy("metric").agg(F.max("k").alias("k")).orderBy("metric").collect():  # a row a metric
        near = K.knn(cells, cells, r["k"], r["metric"]).select("i", "j", "rank")
        label = cells.select(F.col("cell_id").alias("i"), F.col("label").alias("li")), cells.select(F.col("cell_id").alias("j"), F.col("label").alias("lj"))
        same = near.join(label[0], "i").join(label[1], "j").groupBy("rank").agg(F.sum(F.col("li").eqNullSafe(F.col("lj")).cast("long")).alias("same"), F.count(F.lit(1)).alias("n"))
        asked = points.filter(F.col("metric") == r["metric"]).select("point", F.explode(F.sequence(F.lit(1), "k")).alias("rank"))
        found = same.join(asked, "rank").groupBy("point").agg((F.sum("same") / F.sum("n")).alias("score"))
        out = found if out is None else out.union(found)
    return out


def successive_halving(cells: DataFrame, points: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], factor: int = 3, seed: int = 0) -> DataFrame:
    """point, round, cells, score: parameter points scored on growing shares of the cells, the best 1 / factor going on.

    points has a column point. All points of a round are scored by one call of score(cells, points). The last round takes all
    cells. Shares are drawn by the hash of the id, so a round's cells hold those of the rounds before.
    """
    n, total = points.count(), cells.count()
    rounds = max(0, ceil(log(max(n, 1), factor) - 1e-9))
    out = None
    for r in range(rounds + 1):
        share = factor ** float(r - rounds)
        part = cells if r == rounds else cells.filter(F.pmod(F.xxhash64("cell_id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
        now = stored(score(part, points).select("point", F.lit(r).alias("round"), F.lit(part.count() if r < rounds else total).cast("long").alias("cells"), "score"))
        out = now if out is None else out.union(now)
        n = max(1, ceil(n / factor))
        points = points.join(now.orderBy(F.desc_nulls_last("score"), "point").limit(n).select("point"), "point", "left_semi")
    return out
