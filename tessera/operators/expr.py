"""Expression matrices in long form (cell_id, gene_id, value; zeros absent): filters, normalisation, gene scores and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vectors import average_rank

MITO_PREFIX, DISPERSION_BINS = "MT-", 20


def filter_cells(expr: DataFrame, min_genes: int = 0, min_counts: float = 0) -> DataFrame:
    """Rows of cells with at least so many genes and so much in total."""
    good = expr.groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("value").alias("s")).filter((F.col("n") >= min_genes) & (F.col("s") >= min_counts))
    return expr.join(good.select("cell_id"), "cell_id", "left_semi")


def filter_genes(expr: DataFrame, min_counts: float = 3, by: tuple[str, ...] = ()) -> DataFrame:
    keys = ["gene_id", *by]
    good = expr.groupBy(*keys).agg(F.sum("value").alias("s")).filter(F.col("s") >= min_counts)
    return expr.join(good.select(*keys), keys, "left_semi")


def filter_prefix_share(expr: DataFrame, prefix: str = MITO_PREFIX, most: float = 0.05) -> DataFrame:
    """Rows of cells in which genes of the prefix hold less than `most` of the counts."""
    share = F.sum(F.when(F.col("gene_id").startswith(prefix), F.col("value")).otherwise(0)) / F.sum("value")
    return expr.join(expr.groupBy("cell_id").agg(share.alias("p")).filter(F.col("p") < most).select("cell_id"), "cell_id", "left_semi")


def drop_prefixes(expr: DataFrame, *prefixes: str) -> DataFrame:
    for p in prefixes:
        expr = expr.filter(~F.col("gene_id").startswith(p))
    return expr


def normalized(expr: DataFrame, to: float = 1e4, log: bool = True) -> DataFrame:
    """Values scaled so that each cell sums to `to`, then ln(1 + x)."""
    x = F.col("value") * to / F.sum("value").over(Window.partitionBy("cell_id"))
    return expr.withColumn("value", F.log1p(x) if log else x)


def scaled(expr: DataFrame, n_cells: int, most: float = 10.0) -> DataFrame:
    """x / sample deviation of the gene over all n_cells (absent is 0), at most `most`; not centred."""
    s = expr.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    dev = s.select("gene_id", F.sqrt((F.col("q") - F.col("s") * F.col("s") / n_cells) / (n_cells - 1)).alias("dev"))
    return expr.join(dev, "gene_id").withColumn("value", F.least(F.col("value") / F.col("dev"), F.lit(most))).drop("dev")


def gene_stats(expr: DataFrame, by: tuple[str, ...] = ("batch",)) -> DataFrame:
    """mean, var and dispersion of each gene over all cells of its group: absent values count as 0."""
    cells = expr.groupBy(*by).agg(F.countDistinct("cell_id").alias("n_cells"))
    s = expr.groupBy(*by, "gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / F.col("n_cells")
    out = s.join(cells, list(by)).withColumns({"mean": mean, "var": F.col("q") / F.col("n_cells") - mean * mean})
    return out.withColumn("dispersion", F.when(F.col("mean") > 0, F.col("var") / F.col("mean"))).select(*by, "gene_id", "mean", "var", "dispersion")


def gene_scores(expr: DataFrame, method: str = "cell_ranger", by: tuple[str, ...] = ("batch",)) -> DataFrame:
    """by, gene_id, score. mean: mean of ln(1 + x) normalised values; mean_raw: of the values; dispersion: var / mean;
    cell_ranger: (dispersion - median) / median absolute deviation within bins of equal size by mean."""
    if method == "mean_raw":
        return gene_stats(expr, by).select(*by, "gene_id", F.col("mean").alias("score"))
    if method == "mean":
        return gene_stats(normalized(expr), by).select(*by, "gene_id", F.col("mean").alias("score"))
    stats = gene_stats(normalized(filter_genes(expr, 3, by), log=False), by)
    if method == "dispersion":
        return stats.select(*by, "gene_id", F.col("dispersion").alias("score"))
    if method != "cell_ranger":
        raise ValueError(f"unknown gene score: {method}")
    binned = stats.withColumn("bin", F.ntile(DISPERSION_BINS).over(Window.partitionBy(*by).orderBy("mean", "gene_id")))
    w = Window.partitionBy(*by, "bin")
    binned = binned.withColumn("median", F.percentile("dispersion", 0.5).over(w))
    binned = binned.withColumn("mad", F.percentile(F.abs(F.col("dispersion") - F.col("median")), 0.5).over(w))
    return binned.select(*by, "gene_id", F.when(F.col("mad") > 0, (F.col("dispersion") - F.col("median")) / F.col("mad")).alias("score"))


def binned_dispersion(stats: DataFrame, width: float = 0.25) -> DataFrame:
    """bin, median and population deviation of log dispersion, by log mean in bins of a width."""
    x = stats.filter("mean > 0 and dispersion > 0").select(F.floor(F.log("mean") / width).cast("int").alias("bin"), F.log("dispersion").alias("d"))
    return x.groupBy("bin").agg(F.percentile("d", 0.5).alias("median"), F.stddev_pop("d").alias("dev"), F.count("*").alias("n"))


def residual_scores(stats: DataFrame, width: float = 0.25) -> DataFrame:
    """gene_id, score: log dispersion less its bin's median, over the bin's deviation (a robust fit by bins)."""
    x = stats.filter("mean > 0 and dispersion > 0").withColumn("bin", F.floor(F.log("mean") / width).cast("int"))
    out = x.join(binned_dispersion(stats, width), "bin")
    return out.select("gene_id", F.when(F.col("dev") > 0, (F.log("dispersion") - F.col("median")) / F.col("dev")).alias("score"))


def _ranks(scores: DataFrame) -> DataFrame:
    return scores.filter("score is not null").withColumn("r", F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("score"), "gene_id")))


def top_union(scores: DataFrame, n: int) -> DataFrame:
    """Genes among the n best of any batch."""
    return _ranks(scores).filter(F.col("r") <= n).select("gene_id").distinct()


def top_union_limit(scores: DataFrame, limit: int) -> DataFrame:
    """Genes of the largest n < limit such that the union of the n best of all batches has at most `limit` genes (n >= 1)."""
    best = _ranks(scores).groupBy("gene_id").agg(F.min("r").alias("best"))
    per = best.groupBy("best").count().filter(F.col("best") < limit)  # at most `limit` rows
    total = per.withColumn("c", F.sum("count").over(Window.orderBy("best")))
    n = total.filter((F.col("c") <= limit) | (F.col("best") == 1)).agg(F.max("best").alias("n"))
    return best.join(F.broadcast(n), F.col("best") <= F.col("n")).select("gene_id")


def round_robin(scores: DataFrame, limit: int) -> DataFrame:
    """The first `limit` genes met when the batches take turns, rank by rank."""
    first = _ranks(scores).groupBy("gene_id").agg(F.min(F.struct("r", "batch")).alias("m"))
    return first.orderBy("m.r", "m.batch", "gene_id").limit(limit).select("gene_id")


def drawn(seed: int = 0, key: str = "cell_id") -> Column:
    """The order of a draw without replacement: the MD5 of seed and id, the same in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def even_batches(cells: DataFrame, seed: int = 0) -> DataFrame:
    """So many cells of each batch as the smallest has, by a hash of the id."""
    least = cells.groupBy("batch").count().agg(F.min("count").alias("least"))
    r = F.row_number().over(Window.partitionBy("batch").orderBy(drawn(seed), "cell_id"))
    return cells.withColumn("__r", r).join(F.broadcast(least), F.col("__r") <= F.col("least")).drop("__r", "least")


def subsample(cells: DataFrame, n: int, by: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """n rows (of each group) without replacement by a hash of the id; all where there are fewer."""
    if not by:
        return cells.orderBy(drawn(seed), "cell_id").limit(n)
    r = F.row_number().over(Window.partitionBy(*by).orderBy(drawn(seed), "cell_id"))
    return cells.withColumn("__r", r).filter(F.col("__r") <= n).drop("__r")


def sampled_cells(expr: DataFrame, min_genes: int = 0, remove: dict[str, list] | None = None, size: int | None = None, by: str = "batch", seed: int = 0) -> DataFrame:
    """Rows of at most `size` cells of each `by`, drawn from those with min_genes genes and none of the values to remove.

    remove maps a column to values; a missing value is not one of them. A group of fewer cells is kept whole.
    """
    out = filter_cells(expr, min_genes) if min_genes else expr
    for column, values in (remove or {}).items():
        out = out.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))
    if size is None:
        return out
    cells = subsample(out.select("cell_id", by).distinct(), size, (by,), seed)
    return out.join(cells.select(F.col("cell_id").alias("__id"), F.col(by).alias("__by")), F.col("cell_id").eqNullSafe(F.col("__id")) & F.col(by).eqNullSafe(F.col("__by")), "left_semi")


def subsample_share(cells: DataFrame, amount: float, seed: int = 0) -> DataFrame:
    """Below 1 about that share of the rows, each by its own draw (no shuffle); else `amount` rows."""
    if amount >= 1:
        return subsample(cells, int(amount), seed=seed)
    return cells.filter(F.conv(F.substring(drawn(seed), 1, 8), 16, 10).cast("double") / float(1 << 32) < amount)


def sample_batches(cells: DataFrame, batches: int, cells_a_batch: int, seed: int = 0) -> DataFrame:
    """So many cells of each of so many batches, both drawn."""
    few = cells.select("batch").distinct().orderBy(drawn(seed, "batch"), "batch").limit(batches)
    return subsample(cells.join(F.broadcast(few), "batch", "left_semi"), cells_a_batch, ("batch",), seed)


def bootstrap(cells: DataFrame, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    return cells.sample(withReplacement=True, fraction=fraction, seed=seed)


def stratified_fraction(cells: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """The share of each batch with the least hashes."""
    w = Window.partitionBy("batch")
    r = F.row_number().over(w.orderBy(drawn(seed), "cell_id"))
    return cells.withColumns({"__r": r, "__n": F.count(F.lit(1)).over(w)}).filter(F.col("__r") <= F.ceil(F.col("__n") * fraction)).drop("__r", "__n")


def duplicate_rows(expr: DataFrame) -> DataFrame:
    """cell_id, twin: cells with the same genes and values as an earlier cell."""
    rows = expr.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("gene_id", "value"))).alias("row"))  # one cell's genes
    keyed = rows.select("cell_id", F.sha2(F.to_json("row"), 256).alias("key"))
    first = keyed.groupBy("key").agg(F.min("cell_id").alias("twin"), F.count("*").alias("n")).filter("n > 1")
    return keyed.join(first, "key").filter("cell_id <> twin").select("cell_id", "twin")


def gram(scores: DataFrame, on: str = "batch") -> DataFrame:
    """a, b, value: inner products of the score vectors of all pairs of groups."""
    x = scores.select(F.col(on).alias("a"), "gene_id", F.col("score").alias("s"))
    y = scores.select(F.col(on).alias("b"), "gene_id", F.col("score").alias("t"))
    return x.join(y, "gene_id").groupBy("a", "b").agg(F.sum(F.col("s") * F.col("t")).alias("value"))


def jaccard(scores: DataFrame, n: int) -> DataFrame:
    """a, b, value: Jaccard similarity of the n best genes of all pairs of batches."""
    top = _ranks(scores).filter(F.col("r") <= n)
    size = top.groupBy("batch").count()
    x, y = top.select(F.col("batch").alias("a"), "gene_id"), top.select(F.col("batch").alias("b"), "gene_id")
    both = x.join(y, "gene_id").groupBy("a", "b").agg(F.count("*").alias("both"))
    out = both.join(size.select(F.col("batch").alias("a"), F.col("count").alias("na")), "a").join(size.select(F.col("batch").alias("b"), F.col("count").alias("nb")), "b")
    return out.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("value"))


def masked_cosine(scores: DataFrame, n: int) -> DataFrame:
    """a, b, value: cosine of the score vectors over the n genes of the largest sum of both."""
    x = scores.filter("score is not null").select(F.col("batch").alias("a"), "gene_id", F.col("score").alias("s"))
    y = scores.filter("score is not null").select(F.col("batch").alias("b"), "gene_id", F.col("score").alias("t"))
    r = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc(F.col("s") + F.col("t")), "gene_id"))
    top = x.join(y, "gene_id").withColumn("r", r).filter(F.col("r") <= n)
    return top.groupBy("a", "b").agg((F.sum(F.col("s") * F.col("t")) / F.sqrt(F.sum(F.col("s") * F.col("s")) * F.sum(F.col("t") * F.col("t")))).alias("value"))


def precision_at(sim: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """k, precision: share of the k most similar others (a, b, value) with the label of a."""
    r = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("value"), "b"))
    top = sim.filter("a <> b").withColumn("r", r).filter(F.col("r") <= k)
    la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    return top.join(la, "a").join(lb, "b").agg(F.avg((F.col("la") == F.col("lb")).cast("double")).alias("precision")).select(F.lit(k).alias("k"), "precision")


def adjacency_top(sim: DataFrame, share: float) -> DataFrame:
    """i, j: for each row the most similar ceil(share * n), in both directions."""
    w = Window.partitionBy("a")
    top = sim.withColumns({"r": F.row_number().over(w.orderBy(F.desc("value"), "b")), "n": F.count(F.lit(1)).over(w)}).filter(F.col("r") <= F.ceil(F.col("n") * share))
    return top.select(F.col("a").alias("i"), F.col("b").alias("j")).union(top.select("b", "a")).distinct()


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """by, rho: correlation of average ranks."""
    r = df.withColumns({"__x": average_rank(F.col(x), *by), "__y": average_rank(F.col(y), *by)})
    return r.groupBy(*by).agg(F.corr("__x", "__y").alias("rho"))
