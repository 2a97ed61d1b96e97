"""Readers, writers and the standard tables: cells, expressions (long form), slices, pairs and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Markers that stand for a missing label.
MISSING_LABELS = ("-1", "Unassigned", "nan", "no pangalo", "Unknown")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cells(spark: SparkSession, folder: str, batches: int = 4) -> DataFrame:
    """cell_id, batch, label, vec of the embeddings; the batch is the id modulo `batches`."""
    e = table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("cell_id"), (F.col("vec_id") % batches).cast("int").alias("batch"), "label", F.col("embedding").cast("array<double>").alias("vec"))


def expr_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """cell_id (order), gene_id (part), batch (priority), label (segment), value (quantity)."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("value"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    out = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return out.select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), F.col("o_orderpriority").alias("batch"), F.col("c_mktsegment").alias("label"), "value")


def expr_dense(spark: SparkSession, folder: str) -> DataFrame:
    """cell_id (customer), gene_id (brand), batch (customer modulo 4), label (segment), value (quantity)."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    out = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    out = out.groupBy("o_custkey", "p_brand").agg(F.sum("l_quantity").alias("value")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return out.select(F.col("o_custkey").alias("cell_id"), F.col("p_brand").alias("gene_id"), (F.col("o_custkey") % 4).cast("int").alias("batch"), F.col("c_mktsegment").alias("label"), "value")


def slices(spark: SparkSession, folder: str) -> DataFrame:
    """slice_idx (day, from 1), cell_id, user_id, label, value of the events; days are numbered from their distinct list."""
    e = table(spark, folder, "events").withColumn("day", F.date_trunc("day", "ts"))
    days = e.select("day").distinct().withColumn("slice_idx", F.row_number().over(Window.orderBy("day")))  # one row a day
    return e.join(F.broadcast(days), "day").select("slice_idx", F.col("event_id").alias("cell_id"), "user_id", F.col("event_type").alias("label"), "value")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """a, b: the types of consecutive events of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, folder, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"))
    return e.filter("b is not null")


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """dataset (nation), method (segment), label_mean, batch_mean: positive scores (1e-9 keeps exact halves from rounding either way)."""
    o, c, li = (table(spark, folder, n) for n in ("orders", "customer", "lineitem"))
    per = c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("dataset"), F.col("c_mktsegment").alias("method")).agg(F.avg("o_totalprice").alias("p"))
    disc = li.select("l_orderkey", "l_discount").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    disc = disc.groupBy(F.col("c_nationkey").alias("dataset"), F.col("c_mktsegment").alias("method")).agg((F.avg("l_discount") + 0.01).alias("batch_mean"))
    most = per.agg(F.max("p").alias("most"))
    return per.crossJoin(most).join(disc, ["dataset", "method"]).select("dataset", "method", F.round(F.col("p") / F.col("most") + 1e-9, 6).alias("label_mean"), F.round(F.col("batch_mean") + 1e-9, 6).alias("batch_mean"))


# The same tables as DuckDB views, for the oracles.
VIEWS = {
    "cells_v": "select vec_id as cell_id, (vec_id % 4)::int as batch, label, embedding::double[] as vec from embeddings",
    "expr_sparse": "select l_orderkey as cell_id, l_partkey as gene_id, o_orderpriority as batch, c_mktsegment as label, sum(l_quantity) as value from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all",
    "expr_dense": "select o_custkey as cell_id, p_brand as gene_id, (o_custkey % 4)::int as batch, c_mktsegment as label, sum(l_quantity) as value from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join customer on o_custkey = c_custkey group by all",
    "slices": "select dense_rank() over (order by date_trunc('day', ts))::int as slice_idx, event_id as cell_id, user_id, event_type as label, value from events",
    "pairs": "select a, b from (select event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events) where b is not null",
    "scores_v": """select dataset, method, round(p / max(p) over () + 1e-9, 6) as label_mean, round(d + 1e-9, 6) as batch_mean from
        (select c_nationkey as dataset, c_mktsegment as method, avg(o_totalprice) as p from customer join orders on c_custkey = o_custkey group by all) join
        (select c_nationkey as dataset, c_mktsegment as method, avg(l_discount) + 0.01 as d from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all) using (dataset, method)""",
}


def sql(body: str, *names: str) -> str:
    """An oracle statement over the named views."""
    return "with " + ", ".join(f"{n} as materialized ({VIEWS[n]})" for n in names) + (", " if body.startswith("+") else " ") + body.removeprefix("+")


# ---- files ----


def read_labelled(spark: SparkSession, paths, batch: str, label: str, fmt: str = "parquet", **options) -> DataFrame:
    """Rows of files with the named columns copied to `batch` and `label`, and missing labels as null."""
    return rename_obs(spark.read.format(fmt).options(**options).load(paths), batch, label)


def rename_obs(df: DataFrame, batch: str, label: str) -> DataFrame:
    out = df.withColumns({"batch": F.col(batch), "label": F.col(label)})
    return out.withColumn("label", F.when(F.col("label").cast("string").isin(*MISSING_LABELS), None).otherwise(F.col("label")))


def read_datasets(spark: SparkSession, root: str, columns: dict[str, tuple[str, str]], names=None, timeseries: bool = False, drop_missing: bool = False, min_cells: int = 0, fmt: str = "parquet", suffix: str = ".parquet", **options) -> dict[str, DataFrame]:
    """One table for each data set: its rows with dataset, batch, label and timeseries.

    columns maps a data set to its own names of batch and label; `names` picks some of them. The file is root/name + suffix.
    Batches stay rows, told by their column; those of fewer than min_cells rows, as counted after drop_missing has taken out
    the rows with no label, are left out.
    """
    out = {}
    for name in names or columns:
        batch, label = columns[name]
        df = read_labelled(spark, f"{root}/{name}{suffix}", batch, label, fmt, **options)
        df = df.withColumns({"dataset": F.lit(name), "timeseries": F.lit(timeseries)})
        df = df.filter("label is not null") if drop_missing else df
        if min_cells:
            large = df.groupBy(F.col("batch").alias("__batch")).count().filter(F.col("count") >= min_cells)
            df = df.join(large, F.col("batch").eqNullSafe(F.col("__batch")), "left_semi")
        out[name] = df
    return out


def read_matrices(spark: SparkSession, paths, sep: str = "\t") -> DataFrame:
    """Delimited gene x cell matrices, each file with its own cells: gene_id, cell_id, value, fname, tissue, tissue5, tissue5id.

    A file's first line names its cells. Values are matched to names by their place in the line, by a join, so that a plan does
    not grow with the columns. fname is the file's name up to its first dot; tissue its part before the first _, tissue5 five
    characters of that, tissue5id these and the part after the last _. Zeros, and what is not a number, are left out.
    """
    place = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")]
    lines = spark.read.text(paths).select("value", *place).filter("trim(value) <> ''")
    first = lines.filter("at = 0").groupBy("f").agg(F.min("n").alias("n"))  # a row a file
    quoted = lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")
    parts = F.split("value", "\\Q" + sep + "\\E")
    heads = lines.join(first, ["f", "n"], "left_semi").select(F.col("f").alias("f"), F.posexplode(parts).alias("pos", "cell"))
    heads = heads.filter("pos > 0").select("f", "pos", quoted("cell").alias("cell_id"))
    body = lines.join(first, ["f", "n"], "left_anti").select("f", parts.alias("p")).select("f", quoted(F.col("p")[0]).alias("gene_id"), F.posexplode("p").alias("pos", "x"))
    body = body.filter("pos > 0").withColumn("value", F.expr("try_cast(x as double)")).filter("value <> 0")
    out = body.join(heads, ["f", "pos"]).withColumn("fname", F.regexp_extract("f", r"([^/.]*)[^/]*$", 1))
    tissue = F.substring_index("fname", "_", 1)
    return out.select("gene_id", "cell_id", "value", "fname", tissue.alias("tissue"), F.substring(tissue, 1, 5).alias("tissue5"), F.concat_ws("_", F.substring(tissue, 1, 5), F.substring_index("fname", "_", -1)).alias("tissue5id"))


def read_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A delimited gene x cell matrix as gene_id, cell_id, value; zeros are left out."""
    wide = spark.read.csv(path, sep=sep, header=True)
    gene, *names = wide.columns
    long = wide.unpivot([F.col(f"`{gene}`").alias("gene_id")], [F.col(f"`{n}`") for n in names], "cell_id", "value")
    return long.select("gene_id", "cell_id", F.col("value").cast("double").alias("value")).filter("value <> 0")


def read_mtx(spark: SparkSession, path: str, genes: DataFrame | None = None, barcodes: DataFrame | None = None) -> DataFrame:
    """A Matrix-Market file as gene_idx, cell_idx, value; with (idx, name) tables the names are joined on."""
    # Each file's first line without a comment holds its sizes; it is the one with the least place in its file.
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"))
    lines = lines.filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    sizes = lines.groupBy("f").agg(F.min("n").alias("n"))  # a row a file
    part = F.split(F.trim("value"), r"\s+")
    out = lines.join(F.broadcast(sizes), ["f", "n"], "left_anti").select(part[0].cast("long").alias("gene_idx"), part[1].cast("long").alias("cell_idx"), part[2].cast("double").alias("value"))
    if genes is not None:
        out = out.join(genes.select(F.col("idx").alias("gene_idx"), F.col("name").alias("gene_id")), "gene_idx")
    if barcodes is not None:
        out = out.join(barcodes.select(F.col("idx").alias("cell_idx"), F.col("name").alias("cell_id")), "cell_idx")
    return out


def read_counts(spark: SparkSession, counts: str, labels: str, sep: str = "\t", label_sep: str = ",") -> DataFrame:
    """gene_id, cell_id, value, label from a delimited gene x cell matrix and a file of (cell id, label) with a header."""
    named = spark.read.csv(labels, sep=label_sep, header=True)
    cell, label = named.columns[:2]
    return read_matrix(spark, counts, sep).join(named.select(F.col(f"`{cell}`").alias("cell_id"), F.col(f"`{label}`").alias("label")), "cell_id")


def labelled_slices(df: DataFrame, column: str, wanted, label: str, cell: str = "cell_id", most: int | None = None, seed: int = 0) -> DataFrame:
    """Rows of the wanted slices that have a label, at most `most` of each slice drawn by their id, with `batch` and `label`."""
    out = rename_obs(df.filter(F.col(column).isin(*wanted)), column, label).filter("label is not null")
    if most is None:
        return out
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(cell).cast("string")))
    return out.withColumn("__r", F.row_number().over(Window.partitionBy("batch").orderBy(draw, cell))).filter(F.col("__r") <= most).drop("__r")


def batch_of_id(df: DataFrame, column: str, sep: str = "_", drop: Column | None = None) -> DataFrame:
    """df with `batch`, the part of an id before the first separator; rows for which `drop` holds (doublets) go."""
    out = df if drop is None else df.filter(~F.coalesce(drop, F.lit(False)))
    return out.withColumn("batch", F.substring_index(F.col(column).cast("string"), sep, 1))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_typed_header(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Delimited files whose second line names each column's type (`numeric` or `group`), told by its place in its file."""
    place = {"__f": F.col("_metadata.file_path"), "__at": F.col("_metadata.file_block_start"), "__n": F.monotonically_increasing_id()}
    head = spark.read.csv(path, sep=sep, header=True)
    names = head.columns
    head = head.withColumns(place)
    first = head.filter("__at = 0").groupBy("__f").agg(F.min("__n").alias("__n"))  # a row a file
    kinds = head.join(first, ["__f", "__n"]).orderBy("__f").select(*[f"`{c}`" for c in names]).first()
    out = head.join(first, ["__f", "__n"], "left_anti").select(*[f"`{c}`" for c in names])
    numeric = [c for c in names if kinds is not None and kinds[c] == "numeric"]
    return out.withColumns({c: F.col(f"`{c}`").cast("double") for c in numeric})


def read_through(spark: SparkSession, path: str, make) -> DataFrame:
    """What is written at path; make() is called, and its result written, only where nothing is."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    make().write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def decode_plus_one(expr: DataFrame) -> DataFrame:
    """Counts that were stored one higher."""
    return expr.withColumn("value", F.col("value") - 1).filter("value <> 0")


def blobs(spark: SparkSession, sizes: dict[tuple[int, int], int], cluster_spread: float = 0.3, batch_spread: float = 2.0, seed: int = 1) -> DataFrame:
    """Gaussian points around (label, batch * spread): cell_id, batch, label, vec."""
    parts = None
    for k, ((batch, label), n) in enumerate(sorted(sizes.items())):
        centre = (float(label), batch * batch_spread)
        p = spark.range(n).select(F.lit(batch).alias("batch"), F.lit(label).alias("label"), F.array(*[F.lit(c) + F.randn(seed + 2 * k + i) * cluster_spread for i, c in enumerate(centre)]).alias("vec"), F.lit(k).alias("part"), F.col("id"))
        parts = p if parts is None else parts.union(p)
    return parts.select((F.col("part") * 1_000_000_000 + F.col("id")).alias("cell_id"), "batch", "label", "vec")


def write_nested_json(scores_: DataFrame, path: str) -> None:
    """Score rows as one JSON line for each dataset: {dataset, methods: {method: {...}}}."""
    values = [c for c in scores_.columns if c not in ("dataset", "method")]
    nested = scores_.groupBy("dataset").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", F.struct(*values))))).alias("methods"))
    nested.write.mode("overwrite").json(path)


def read_nested_json(spark: SparkSession, path: str, values: str, dataset: str = "string") -> DataFrame:
    df = spark.read.schema(f"dataset {dataset}, methods map<string, struct<{values}>>").json(path)
    return df.select("dataset", F.explode("methods").alias("method", "s")).select("dataset", "method", "s.*")


def _report_rows(df: DataFrame, limit: int) -> list[list[str]]:
    """The cells of a report's first rows as text, and a last row of dots where there are more."""
    found = df.limit(limit + 1).collect()
    rows = [[("" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)) for v in r] for r in found[:limit]]
    return rows + [["..."] * len(df.columns)] * (len(found) > limit)


def as_markdown(df: DataFrame, limit: int = 200) -> str:
    """A small table as markdown text; rows beyond `limit` are left out, with a last row of dots that says so."""
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *_report_rows(df, limit)])


def as_latex(df: DataFrame, limit: int = 200) -> str:
    """A small table as LaTeX; rows beyond `limit` are left out, with a last row of dots that says so."""
    body = " \\\\\n".join(" & ".join(r) for r in [df.columns, *_report_rows(df, limit)])
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n{body} \\\\\n\\end{{tabular}}"
