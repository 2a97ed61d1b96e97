"""Label transfer between batches, batch correction, clustering steps and reduction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import knn as K
from tessera.operators import match as M
from tessera.operators.correct import harmony, linked_sums, scanorama
from tessera.operators.graph import cut
from tessera.operators.stage import stored


def _vectors(long: DataFrame, x: str, *keys: str) -> DataFrame:
    """keys, vec from rows (keys, dim, x)."""
    return long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dim", F.col(x).alias("x")))).alias("l")).select(*keys, F.col("l.x").alias("vec"))


def centroids(cells: DataFrame, *by: str) -> DataFrame:
    """by, vec, n: the mean vector of each group."""
    long = cells.select(*by, F.posexplode("vec").alias("dim", "x")).groupBy(*by, "dim").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return long.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("l"), F.max("n").alias("n")).select(*by, F.col("l.x").alias("vec"), "n")


def label_knn(target: DataFrame, source: DataFrame, k: int = 5) -> DataFrame:
    """cell_id, label: the commonest label of the k nearest source cells, the smallest on ties."""
    near = K.knn(target, source, k, "euclidean", self_too=True)
    return near.join(source.select(F.col("cell_id").alias("j"), "label"), "j").groupBy(F.col("i").alias("cell_id")).agg(F.mode("label", True).alias("label"))


def copy_labels(cells: DataFrame, source_batch, target_batch, metric: str = "euclidean") -> DataFrame:
    """cell_id, label: the label of the cell matched one to one in the source batch."""
    two = cells.filter(F.col("batch").isin(source_batch, target_batch))
    pair = two.sparkSession.range(1).select(F.lit(source_batch).cast(cells.schema["batch"].dataType).alias("a"), F.lit(target_batch).cast(cells.schema["batch"].dataType).alias("b"))
    m = M.matched(two, pair, 1, metric)
    return m.join(cells.select(F.col("cell_id").alias("i"), "label"), "i").select(F.col("j").alias("cell_id"), "label")


def majority(votes: DataFrame, item: str, source: str, label: str) -> DataFrame:
    """item, label: the commonest label; of equal ones that of the first source."""
    n = votes.groupBy(item, label).agg(F.count("*").alias("n"), F.min(source).alias("first"))
    r = F.row_number().over(Window.partitionBy(item).orderBy(F.desc("n"), "first", label))
    return n.withColumn("r", r).filter("r = 1").select(item, label)


def assign(cells: DataFrame, centres: DataFrame) -> DataFrame:
    """cell_id, cluster, d: the nearest centre (few: they are sent to all tasks; cluster, vec)."""
    near = K.knn(cells, centres.select(F.col("cluster").cast("long").alias("cell_id"), "vec"), 1, "euclidean", self_too=True)
    return near.select(F.col("i").alias("cell_id"), F.col("j").alias("cluster"), "d")


def k_means(cells: DataFrame, centres: DataFrame, rounds: int = 10) -> DataFrame:
    """cell_id, cluster after at most `rounds` rounds of assignment and means; stops when no cell moves."""
    last = None
    for _ in range(rounds):
        now = cut(assign(cells, centres).select("cell_id", "cluster"))
        if last is not None and now.exceptAll(last).isEmpty():
            break
        last = now
        centres = centroids(cells.join(now, "cell_id"), "cluster").select("cluster", "vec")
    return now


def paired_assign(views: list[DataFrame], centres: list[DataFrame]) -> DataFrame:
    """cell_id, cluster, disagree: the nearest centre over aligned views of the same cells, and whether views differ."""
    each = None
    for v, c in zip(views, centres, strict=True):
        a = assign(v, c)
        each = a if each is None else each.union(a)
    return each.groupBy("cell_id").agg(F.min(F.struct("d", "cluster"))["cluster"].alias("cluster"), (F.countDistinct("cluster") > 1).alias("disagree"))


def combat(cells: DataFrame, ridge: float = 1e-9) -> DataFrame:
    """cells corrected for batch location and scale, each shrunk to its batch's prior over the dimensions (empirical Bayes).

    One pass of posterior means: the location prior is normal, the scale prior inverse gamma, fitted by moments.
    """
    long = cells.select("cell_id", "batch", F.posexplode("vec").alias("dim", "x"))
    g = long.groupBy("batch", "dim").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    every = Window.partitionBy("dim")
    g = g.withColumns({"grand": F.sum(F.col("n") * F.col("m")).over(every) / F.sum("n").over(every), "pooled": F.sum(F.col("n") * F.col("v")).over(every) / F.sum("n").over(every) + ridge})
    g = g.withColumns({"gamma": (F.col("m") - F.col("grand")) / F.sqrt("pooled"), "delta": F.col("v") / F.col("pooled")})
    w = Window.partitionBy("batch")
    g = g.withColumns({"gbar": F.avg("gamma").over(w), "t2": F.var_samp("gamma").over(w), "dbar": F.avg("delta").over(w), "s2": F.var_samp("delta").over(w) + ridge})
    a = (2 * F.col("s2") + F.col("dbar") * F.col("dbar")) / F.col("s2")
    b = (F.col("dbar") * F.col("s2") + F.pow("dbar", F.lit(3))) / F.col("s2")
    g = g.withColumn("gstar", (F.col("t2") * F.col("n") * F.col("gamma") + F.col("delta") * F.col("gbar")) / (F.col("t2") * F.col("n") + F.col("delta") + ridge))
    g = g.withColumn("dstar", (b + F.col("n") * F.col("delta") / 2) / (F.col("n") / 2 + a - 1))
    fit = g.select("batch", "dim", "grand", "pooled", "gstar", "dstar")
    z = (F.col("x") - F.col("grand")) / F.sqrt("pooled")
    out = long.join(fit, ["batch", "dim"]).withColumn("y", (z - F.col("gstar")) / F.sqrt("dstar") * F.sqrt("pooled") + F.col("grand"))
    return cells.drop("vec").join(_vectors(out, "y", "cell_id"), "cell_id")


def mnn_correct(cells: DataFrame, reference, batch, k: int = 20, metric: str = "euclidean") -> DataFrame:
    """The cells of `batch` moved by the mean shift of the mutual neighbours nearest to them; cell_id, vec."""
    ref, own = cells.filter(F.col("batch") == reference), cells.filter(F.col("batch") == batch)
    pairs = stored(K.mutual(K.knn(own, ref, k, metric), K.knn(ref, own, k, metric)).select("i", "j", F.lit(1.0).alias("w")))
    sums = linked_sums(pairs, ref).withColumnRenamed("i", "cell_id").join(own.select("cell_id", "vec"), "cell_id")
    shift = stored(sums.select("cell_id", F.zip_with("m", "vec", lambda s, x: s / F.col("w") - x).alias("shift")))
    anchors = own.join(shift.select("cell_id"), "cell_id", "left_semi")
    near = K.knn(own, anchors, k, metric, self_too=True)
    sigma = F.avg("d").over(Window.partitionBy("i")) + 1e-9
    weighted = stored(near.withColumn("sigma", sigma).select("i", "j", F.exp(-F.col("d") * F.col("d") / (2 * F.col("sigma") * F.col("sigma"))).alias("w")))
    move = linked_sums(weighted, shift.select("cell_id", F.col("shift").alias("vec")))
    move = move.select(F.col("i").alias("cell_id"), F.when(F.col("w") > 0, F.transform("m", lambda x: x / F.col("w"))).alias("move"))
    return own.join(move, "cell_id", "left").select("cell_id", F.when(F.col("move").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "move", lambda x, y: x + y)).alias("vec"))


def pca(cells: DataFrame, dims: int = 40) -> DataFrame:
    """cells with vec as its first principal components; as they are where they have no more dimensions."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    width = cells.select(F.size("vec").alias("n")).first()
    if width is None or width["n"] <= dims:
        return cells
    x = cells.withColumn("__v", array_to_vector("vec"))
    return PCA(k=dims, inputCol="__v", outputCol="__p").fit(x).transform(x).withColumn("vec", vector_to_array("__p")).drop("__v", "__p")


#: Integration methods by name: cells -> cells or an edge table.
METHODS = {"combat": combat, "harmony": harmony, "scanorama": scanorama, "bbknn": lambda cells: K.balanced_knn(cells, 3)}
