"""Gene selectors that fit a curve: standardised variance over a local regression, and residual dispersion over a robust line."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.stage import stored

#: Genes whose local regression is one task's work.
BLOCK = 256


def local_quadratic(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Locally weighted regression of degree 2 of y on x, evaluated at the points `at`.

    The floor(span * n) nearest points count (three at least), by the tricube of their distance over that of the farthest.
    """
    q = min(len(x), max(3, int(span * len(x) + 1e-5)))
    u = x[None] - at[:, None]
    d = np.abs(u)
    h = np.partition(d, q - 1, axis=1)[:, q - 1 : q]
    w = np.clip(1 - np.divide(d, h, out=np.zeros_like(d), where=h > 0) ** 3, 0, None) ** 3
    w[(d > h) | ((h == 0) & (d > 0))] = 0
    scale = np.where(h > 0, h, 1)
    u = u / scale  # powers of at most 1 keep the equations well conditioned
    powers = np.stack([np.ones_like(u), u, u * u])
    left = np.einsum("aij,bij,ij->iab", powers, powers, w)
    right = np.einsum("aij,ij,j->ia", powers, w, y)
    return np.einsum("iab,ib->ia", np.linalg.pinv(left, rcond=1e-10), right)[:, 0]


#: Percentiles of the means between which genes are compared, and the factor of a median absolute deviation.
CUTS, MAD_FACTOR = tuple(range(10, 101, 5)), 1 / 0.6744897501960817


def cell_ranger(expr: DataFrame, cells: DataFrame, top: int = 5_000, least: float = 3.0, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """batch, gene_id, score, selected: dispersion of ln(1 + x) of normalised counts against genes of a like mean.

    Genes of fewer than `least` counts in a batch are left out. Cells are scaled to 10,000 counts before the logarithm; the
    dispersion is the sample variance over the mean, absent counts being 0. Genes are binned at percentiles of the means (a mean
    equal to a cut belongs below it); the score is the dispersion less its bin's median, over the bin's scaled median absolute
    deviation, null where that is 0. selected: among the `top` scores of the batch, ties by gene.
    """
    n = cells.groupBy("batch").agg(F.count_distinct("cell_id").alias("n"))
    known = expr.groupBy("batch", "gene_id").agg(F.sum("value").alias("t")).filter(F.col("t") >= least).select("batch", "gene_id")
    depth = expr.groupBy("batch", "cell_id").agg(F.sum("value").alias("depth"))
    x = expr.join(depth.filter("depth > 0"), ["batch", "cell_id"]).withColumn("x", F.log1p(F.col("value") * 1e4 / F.col("depth")))
    sums = x.join(known, ["batch", "gene_id"], "left_semi").groupBy("batch", "gene_id").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss")).join(n, "batch")
    mean = F.col("s") / F.col("n")
    # Written once: sums of another run may differ in their last bit, and a mean that is a cut would change its bin.
    stats = stored(sums.select("batch", "gene_id", mean.alias("mean"), F.try_divide(F.try_divide(F.col("ss") - F.col("s") * mean, F.col("n") - 1), mean).alias("d")))
    at = stats.groupBy("batch").agg(F.percentile("mean", F.array(*[F.lit(c / 100) for c in cuts])).alias("at"))  # a few numbers a batch
    binned = stats.join(at, "batch").select("batch", "gene_id", "d", F.size(F.filter("at", lambda c: F.col("mean") > c)).alias("bin"))
    middle = binned.groupBy("batch", "bin").agg(F.percentile("d", 0.5).alias("m"))
    off = binned.join(middle, ["batch", "bin"]).withColumn("off", F.abs(F.col("d") - F.col("m")))
    spread = off.groupBy("batch", "bin").agg((F.percentile("off", 0.5) * MAD_FACTOR).alias("mad"))
    scored = off.join(spread, ["batch", "bin"]).select("batch", "gene_id", F.try_divide(F.col("d") - F.col("m"), F.col("mad")).alias("score"))
    r = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc_nulls_last("score"), "gene_id"))  # genes of a batch: some ten thousand
    return scored.withColumn("selected", (r <= top) & F.col("score").isNotNull())


def standardised_variance(expr: DataFrame, cells: DataFrame, span: float = 0.3) -> DataFrame:
    """batch, gene_id, score: the variance of counts clipped and standardised by what their mean lets expect.

    expr has batch, cell_id, gene_id and value (counts; absent is 0), cells has batch and cell_id of all cells. The sample
    variance's logarithm is regressed on the mean's, over the genes of a batch that vary; a count is clipped at mean + sqrt(n) *
    expected deviation. Genes that do not vary score 0. The genes of a batch are copied to each block of genes that is evaluated:
    they are some ten thousand rows, whatever the number of cells.
    """
    n = cells.groupBy("batch").agg(F.count_distinct("cell_id").alias("n"))
    sums = expr.groupBy("batch", "gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")).join(n, "batch")
    mean = F.col("s") / F.col("n")
    stats = sums.select("batch", "gene_id", "n", mean.alias("mean"), F.try_divide(F.col("ss") - F.col("s") * mean, F.col("n") - 1).alias("var"))
    varied = stats.filter((F.col("var") > 0) & (F.col("mean") > 0)).withColumns({"x": F.log10("mean"), "y": F.log10("var")})
    size = varied.groupBy("batch").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("many"))
    dealt = varied.join(size, "batch").withColumn("p", F.pmod(F.xxhash64("gene_id"), F.col("many")))
    points = varied.join(size, "batch").select(F.col("batch").alias("b"), F.col("x").alias("px"), F.col("y").alias("py"), F.explode(F.sequence(F.lit(0), F.col("many").cast("int") - 1)).alias("q"))
    kinds = {c: expr.schema[c].dataType.simpleString() for c in ("batch", "gene_id")}

    def fit(s: pa.Table, t: pa.Table) -> pa.Table:
        at = s.column("x").to_numpy()
        order = np.argsort(t.column("px").to_numpy(), kind="stable")
        made = local_quadratic(t.column("px").to_numpy()[order], t.column("py").to_numpy()[order], at, span) if len(at) else np.empty(0)
        return pa.table({"batch": s.column("batch"), "gene_id": s.column("gene_id"), "fitted": pa.array(made, pa.float64())})

    fitted = dealt.groupBy("batch", "p").cogroup(points.groupBy("b", "q")).applyInArrow(fit, f"batch {kinds['batch']}, gene_id {kinds['gene_id']}, fitted double")
    model = stats.join(fitted, ["batch", "gene_id"], "left").withColumn("dev", F.sqrt(F.pow(F.lit(10.0), "fitted")))
    limit = F.col("mean") + F.sqrt("n") * F.col("dev")
    clipped = expr.join(model.filter("dev is not null"), ["batch", "gene_id"]).withColumn("c", F.least("value", limit)).groupBy("batch", "gene_id").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    out = model.join(clipped, ["batch", "gene_id"], "left")
    score = (F.col("n") * F.col("mean") * F.col("mean") + F.col("cc") - 2 * F.col("c") * F.col("mean")) / ((F.col("n") - 1) * F.col("dev") * F.col("dev"))
    return out.select("batch", "gene_id", F.coalesce(score, F.lit(0.0)).alias("score"))


def huber_line(x: np.ndarray, y: np.ndarray, epsilon: float = 1.35, ridge: float = 1e-4, rounds: int = 2_000) -> tuple[float, float]:
    """(slope, intercept) of the line of least Huber loss with its scale fitted too, by reweighted least squares.

    Minimises sum(s + s h(r / s)) + ridge * slope^2 over the line and s > 0, h(z) = z^2 up to epsilon, else 2 epsilon |z| -
    epsilon^2. For a given s a residual beyond epsilon * s weighs epsilon * s / |r|; for a given line s follows in closed form.
    """
    line, scale = np.array([0.0, float(np.median(y))]), max(float(np.median(np.abs(y - np.median(y)))), 1e-9)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(rounds):
        r = np.abs(y - design @ line)
        out = r > epsilon * scale
        room = len(y) - out.sum() * epsilon**2
        new_scale = max(np.sqrt((r[~out] ** 2).sum() / room), 1e-12) if room > 0 else scale
        w = np.where(r > epsilon * new_scale, epsilon * new_scale / np.maximum(r, 1e-300), 1.0)
        new = np.linalg.solve((design * w[:, None]).T @ design + np.diag([ridge * new_scale, 1e-15]), (design * w[:, None]).T @ y)
        done = np.abs(new - line).max() < 1e-12 and abs(new_scale - scale) < 1e-12
        line, scale = new, new_scale
        if done:
            break
    return float(line[0]), float(line[1])


def dispersion_residuals(stats: DataFrame, low: float = 0.015, high: float = 4.0, width: float = 0.25, first: int = 1) -> DataFrame:
    """batch, gene_id, score: log dispersion less what a robust line expects at the gene's mean, over the deviation so expected.

    stats has batch, gene_id, mean and dispersion. x = ln(1 + mean); genes with low < x < high count, others score 0. Bins of a
    width begin at first * width and end at high, their ends excluded; lines are fitted through the bins' medians and through
    their population deviations at the bins' centres, of which there are high / width at most. Below the first centre the
    larger of the first bin's value and the line's counts. Where no deviation is expected the score is 0.
    """
    x, y = F.log1p("mean"), F.log("dispersion")
    base = stats.select("batch", "gene_id", x.alias("x"), F.when(F.col("dispersion") > 0, y).alias("y")).withColumn("inside", (F.col("x") > low) & (F.col("x") < high) & F.col("y").isNotNull())
    bin_ = F.floor(F.col("x") / width)
    at_edge = F.col("x") == bin_ * width
    boxed = base.filter("inside").withColumn("bin", bin_).filter((F.col("bin") >= first) & (F.col("bin") * width < high) & ~at_edge)
    boxes = boxed.groupBy("batch", "bin").agg(F.median("y").alias("m"), F.stddev_pop("y").alias("s"))
    kind = stats.schema["batch"].dataType.simpleString()

    def lines(t: pa.Table) -> pa.Table:
        t = t.sort_by("bin")
        c = (t.column("bin").to_numpy() + 0.5) * width
        out = {"batch": t.column("batch")[:1], "centre": pa.array([c[0]])}
        for name in ("m", "s"):
            v = t.column(name).to_numpy()
            slope, start = huber_line(c, v)
            out |= {f"{name}_slope": pa.array([slope]), f"{name}_start": pa.array([start]), f"{name}_first": pa.array([max(v[0], slope * c[0] + start)])}
        return pa.table(out)

    fitted = boxes.groupBy("batch").applyInArrow(lines, f"batch {kind}, centre double, m_slope double, m_start double, m_first double, s_slope double, s_start double, s_first double")  # high / width rows a batch
    expected = lambda n: F.when(F.col("x") < F.col("centre"), F.col(f"{n}_first")).otherwise(F.col("x") * F.col(f"{n}_slope") + F.col(f"{n}_start"))
    score = F.when(F.col("inside"), F.try_divide(F.col("y") - expected("m"), expected("s")))
    return base.join(fitted, "batch", "left").select("batch", "gene_id", F.coalesce(score, F.lit(0.0)).alias("score"))
