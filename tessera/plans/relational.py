"""Queries over expressions, slices, pairs and score tables, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vectors import average_rank, gmean, percent_rank, robust_scaled, standardized
from tessera.operators import expr as X
from tessera.operators import score as S
from tessera.operators import transfer as T
from tessera.sources import tables as V
from tessera.sources.tables import sql

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


def brand_scores(spark: SparkSession, d: str) -> DataFrame:
    """batch, gene_id, score: mean value of each brand in each batch of the dense expressions."""
    return X.gene_stats(V.expr_dense(spark, d)).select("batch", "gene_id", F.round("mean", 6).alias("score"))


BRANDS = "batch_sizes as (select batch, count(distinct cell_id) as n_cells from expr_dense group by batch), brand_scores as materialized (select batch, gene_id, round(sum(value) / any_value(n_cells), 6) as score from expr_dense join batch_sizes using (batch) group by batch, gene_id)"
RANKED = "ranked as materialized (select *, row_number() over (partition by batch order by score desc, gene_id) as r from brand_scores)"


@query("f1_drop_unlabelled", "select conv_id, turn, role from conversations where role not in ('-1', 'Unassigned', 'nan', 'system')")
def _(spark, d):
    return V.table(spark, d, "conversations").filter(~F.col("role").isin("-1", "Unassigned", "nan", "system")).select("conv_id", "turn", "role")


@query("f4_filter_cells", sql("select cell_id, count(*) as n, sum(value) as total from expr_sparse group by cell_id having count(*) >= 3 and sum(value) >= 20", "expr_sparse"))
def _(spark, d):
    return X.filter_cells(V.expr_sparse(spark, d), 3, 20).groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("f5_filter_genes", sql("select gene_id, sum(value) as total from expr_sparse group by gene_id having sum(value) >= 500", "expr_sparse"))
def _(spark, d):
    return X.filter_genes(V.expr_sparse(spark, d), 500).groupBy("gene_id").agg(F.sum("value").alias("total"))


@query("f6_prefix_share", sql("select cell_id, round(sum(case when gene_id like 'Brand#1%' then value else 0 end) / sum(value), 6) as share from expr_dense group by cell_id having sum(case when gene_id like 'Brand#1%' then value else 0 end) / sum(value) < 0.2", "expr_dense"))
def _(spark, d):
    e = V.expr_dense(spark, d)
    kept = X.filter_prefix_share(e, "Brand#1", 0.2)
    return kept.groupBy("cell_id").agg(F.round(F.sum(F.when(F.col("gene_id").startswith("Brand#1"), F.col("value")).otherwise(0)) / F.sum("value"), 6).alias("share"))


@query("f8_min_batch", sql("select slice_idx, cell_id from (select *, count(*) over (partition by slice_idx) as n from slices) where n > 99", "slices"))
def _(spark, d):
    s = V.slices(spark, d)
    good = s.groupBy("slice_idx").count().filter("count > 99").select("slice_idx")
    return s.join(good, "slice_idx", "left_semi").select("slice_idx", "cell_id")


@query("f13_first_appearance", "select event_type as label, min(event_id) as first_id, row_number() over (order by min(event_id))::int as position from events group by event_type")
def _(spark, d):
    e = V.table(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.min("event_id").alias("first_id"))
    return e.withColumn("position", F.row_number().over(Window.orderBy("first_id")))


@query("f18_even_batches", "select cell_id, batch from (select vec_id as cell_id, (vec_id % 3)::int as batch, row_number() over (partition by vec_id % 3 order by md5('0:' || vec_id), vec_id) as r from embeddings) where r <= (select min(n) from (select count(*) as n from embeddings group by vec_id % 3))")
def _(spark, d):
    return X.even_batches(V.cells(spark, d, 3)).select("cell_id", "batch")


@query("f20_stratified_fraction", "select cell_id, batch from (select vec_id as cell_id, (vec_id % 4)::int as batch, row_number() over (partition by vec_id % 4 order by md5('0:' || vec_id), vec_id) as r, count(*) over (partition by vec_id % 4) as n from embeddings) where r <= ceil(n * 0.5)")
def _(spark, d):
    return X.stratified_fraction(V.cells(spark, d), 0.5).select("cell_id", "batch")


@query("f27_duplicate_rows", "with rows_ as (select o_custkey as cell_id, string_agg(x, ',' order by x) as k from (select distinct o_custkey, o_orderpriority || o_orderstatus as x from orders) group by o_custkey) select cell_id, m as twin from (select cell_id, min(cell_id) over (partition by k) as m from rows_) where cell_id <> m")
def _(spark, d):
    e = V.table(spark, d, "orders").select(F.col("o_custkey").alias("cell_id"), F.concat("o_orderpriority", "o_orderstatus").alias("gene_id"), F.lit(1.0).alias("value")).distinct()
    return X.duplicate_rows(e)


@query("m1_normalize_log1p", sql("select cell_id, gene_id, round(ln(1 + value * 1e4 / sum(value) over (partition by cell_id)), 6) as value from expr_dense", "expr_dense"))
def _(spark, d):
    return X.normalized(V.expr_dense(spark, d)).select("cell_id", "gene_id", r6("value"))


@query("m3_scale", sql("+stats as (select gene_id, sum(value) as s, sum(value * value) as q from expr_dense group by gene_id), n as (select count(distinct cell_id) as n from expr_dense) select cell_id, gene_id, round(least(value / sqrt((q - s * s / n) / (n - 1)), 10), 6) as value from expr_dense join stats using (gene_id), n", "expr_dense"))
def _(spark, d):
    e = V.expr_dense(spark, d)
    return X.scaled(e, e.select("cell_id").distinct().count()).select("cell_id", "gene_id", r6("value"))


@query("m4_standardize", sql("select cell_id, gene_id, round((value - avg(value) over (partition by batch, gene_id)) / stddev_pop(value) over (partition by batch, gene_id), 6) as value from expr_dense", "expr_dense"))
def _(spark, d):
    return standardized(V.expr_dense(spark, d), "value", "batch", "gene_id").withColumn("value", F.round("value", 6)).select("cell_id", "gene_id", "value")


@query("m5_robust_scale", sql("+q as (select gene_id, avg(value) as m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr from expr_dense group by gene_id) select cell_id, gene_id, round((value - m) / (case when iqr = 0 then 1 else iqr end), 6) as value from expr_dense join q using (gene_id)", "expr_dense"))
def _(spark, d):
    return robust_scaled(V.expr_dense(spark, d), "value", "gene_id").withColumn("value", F.round("value", 6)).select("cell_id", "gene_id", "value")


@query("m12_label_codes", "select c_mktsegment as label, (dense_rank() over (order by c_mktsegment) - 1)::int as code from (select distinct c_mktsegment from customer)")
def _(spark, d):
    s = V.table(spark, d, "customer").select(F.col("c_mktsegment").alias("label")).distinct()
    return s.withColumn("code", F.dense_rank().over(Window.orderBy("label")) - 1)


@query("j1_left_lookup", "select event_id, case when k < 25 then k // 10 else -1 end::bigint as cluster from (select event_id, cast(json_extract_string(props, '$.k') as int) as k from events)")
def _(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    lookup = spark.range(25).select(F.col("id").cast("int").alias("k"), (F.col("id") / 10).cast("long").alias("cluster"))
    return e.join(F.broadcast(lookup), "k", "left").select("event_id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


@query("j2_composite_lookup", "select p_partkey, coalesce(n_name, 'no entry') as name from (select *, try_cast(regexp_extract(p_brand, '#(\\d+)', 1) as int) as k from part) left join nation on n_nationkey = k")
def _(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int").alias("k"))
    n = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return p.join(n, "k", "left").select("p_partkey", F.coalesce("name", F.lit("no entry")).alias("name"))


@query("j5_positional_zip", "select x.label as a, y.label as b, count(*) as n from (select label, row_number() over (order by vec_id) as r from embeddings where vec_id % 2 = 0) x join (select label, row_number() over (order by vec_id) as r from embeddings where vec_id % 2 = 1) y using (r) group by all")
def _(spark, d):
    c = V.cells(spark, d, 2).withColumn("r", F.row_number().over(Window.partitionBy("batch").orderBy("cell_id")))
    x, y = c.filter("batch = 0").select("r", F.col("label").alias("a")), c.filter("batch = 1").select("r", F.col("label").alias("b"))
    return x.join(y, "r").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("j19_grid", "select n_name as dataset, m as method from nation, (select distinct c_mktsegment as m from customer)")
def _(spark, d):
    m = V.table(spark, d, "customer").select(F.col("c_mktsegment").alias("method")).distinct()
    return V.table(spark, d, "nation").select(F.col("n_name").alias("dataset")).join(m)


@query("j20_outer_columns", sql("select method, round(x, 6) as even, round(y, 6) as low from (select method, avg(label_mean) as x from scores_v where dataset % 2 = 0 group by method) full join (select method, avg(label_mean) as y from scores_v where label_mean < 0.5 group by method) using (method)", "scores_v"))
def _(spark, d):
    s = V.scores(spark, d)
    a = s.filter("dataset % 2 = 0").groupBy("method").agg(F.round(F.avg("label_mean"), 6).alias("even"))
    b = s.filter("label_mean < 0.5").groupBy("method").agg(F.round(F.avg("label_mean"), 6).alias("low"))
    return a.join(b, "method", "outer")


@query("j21_scores_runtimes", sql("+t as (select c_nationkey as dataset, c_mktsegment as method, round(sum(c_acctbal), 2) as runtime from customer where c_nationkey < 10 group by all) select dataset, method, label_mean, runtime from scores_v join t using (dataset, method)", "scores_v"))
def _(spark, d):
    t = V.table(spark, d, "customer").filter("c_nationkey < 10").groupBy(F.col("c_nationkey").alias("dataset"), F.col("c_mktsegment").alias("method")).agg(F.round(F.sum("c_acctbal"), 2).alias("runtime"))
    return V.scores(spark, d).join(t, ["dataset", "method"]).select("dataset", "method", "label_mean", "runtime")


@query("a1_label_counts", sql("select slice_idx, label, count(*) as n from slices group by all", "slices"))
def _(spark, d):
    return V.slices(spark, d).groupBy("slice_idx", "label").agg(F.count("*").alias("n"))


@query("a3_dice_confusion", sql("select a, b, n, round(2 * n / (sum(n) over (partition by a) + sum(n) over (partition by b)), 6) as dice from (select a, b, count(*) as n from pairs group by all)", "pairs"))
def _(spark, d):
    return S.confusion(V.pairs(spark, d), "a", "b").select("a", "b", "n", r6("dice"))


@query("a5_mean_std", sql("select method, round(avg(label_mean), 6) as mean, round(stddev_samp(label_mean), 6) as std, round(stddev_pop(label_mean), 6) as std_pop from scores_v group by method", "scores_v"))
def _(spark, d):
    return V.scores(spark, d).groupBy("method").agg(F.round(F.avg("label_mean"), 6).alias("mean"), F.round(F.stddev_samp("label_mean"), 6).alias("std"), F.round(F.stddev_pop("label_mean"), 6).alias("std_pop"))


@query("a8_gmean_by_method", sql("select method, round(exp(avg(ln(label_mean))), 6) as label, round(exp(avg(ln(batch_mean))), 6) as batch, round(exp((sum(ln(label_mean)) + sum(ln(batch_mean))) / (2 * count(*))), 6) as both from scores_v group by method", "scores_v"))
def _(spark, d):
    both = F.exp((F.sum(F.log("label_mean")) + F.sum(F.log("batch_mean"))) / (2 * F.count("*")))
    return V.scores(spark, d).groupBy("method").agg(F.round(gmean("label_mean"), 6).alias("label"), F.round(gmean("batch_mean"), 6).alias("batch"), F.round(both, 6).alias("both"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("a10_pivot", sql("select dataset, " + ", ".join(f"max(case when method = '{s}' then label_mean end) as {s.lower()}" for s in SEGMENTS) + " from scores_v group by dataset", "scores_v"))
def _(spark, d):
    out = V.scores(spark, d).groupBy("dataset").pivot("method", SEGMENTS).agg(F.max("label_mean"))
    return out.select("dataset", *[F.col(s).alias(s.lower()) for s in SEGMENTS])


@query("a12_unpivot", sql("select dataset, method, 'label_mean' as metric, label_mean as value from scores_v union all select dataset, method, 'batch_mean', batch_mean from scores_v", "scores_v"))
def _(spark, d):
    return V.scores(spark, d).unpivot(["dataset", "method"], ["label_mean", "batch_mean"], "metric", "value")


@query("a13_majority", "select user_id, label from (select *, row_number() over (partition by user_id order by n desc, m, label) as r from (select user_id, event_type as label, count(*) as n, min(event_id) as m from events group by all)) where r = 1")
def _(spark, d):
    e = V.table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("label"))
    return T.majority(e, "user_id", "event_id", "label")


@query("a16_dispersion", sql("+n as (select batch, count(distinct cell_id) as n from expr_dense group by batch), s as (select batch, gene_id, sum(value) as s, sum(value * value) as q from expr_dense group by all) select batch, gene_id, round(s / n, 6) as mean, round(q / n - (s / n) * (s / n), 4) as var from s join n using (batch)", "expr_dense"))
def _(spark, d):
    return X.gene_stats(V.expr_dense(spark, d)).select("batch", "gene_id", r6("mean"), F.round("var", 4).alias("var"))


@query("a17_binned_dispersion", sql("+x as (select floor(ln(score) / 0.25)::int as bin, ln(score) as d from brand_scores) select bin, round(quantile_cont(d, 0.5), 6) as median, round(stddev_pop(d), 6) as dev, count(*) as n from x group by bin", "expr_dense").replace("x as (select floor", BRANDS + ", x as (select floor"))
def _(spark, d):
    s = brand_scores(spark, d).select(F.col("score").alias("mean"), F.col("score").alias("dispersion"))
    return X.binned_dispersion(s).select("bin", r6("median"), r6("dev"), "n")


@query("a18_spearman", sql("+r as (select dataset, rank() over (partition by dataset order by label_mean) + (count(*) over (partition by dataset, label_mean) - 1) / 2 as x, rank() over (partition by dataset order by batch_mean) + (count(*) over (partition by dataset, batch_mean) - 1) / 2 as y from scores_v) select dataset, round(corr(x, y), 6) as rho from r group by dataset", "scores_v"))
def _(spark, d):
    return X.spearman(V.scores(spark, d), "label_mean", "batch_mean", "dataset").select("dataset", r6("rho"))


@query("a19_describe", sql("select batch, count(distinct cell_id) as cells, count(distinct gene_id) as genes, count(distinct label) as labels from expr_sparse group by batch", "expr_sparse"))
def _(spark, d):
    return V.expr_sparse(spark, d).groupBy("batch").agg(F.countDistinct("cell_id").alias("cells"), F.countDistinct("gene_id").alias("genes"), F.countDistinct("label").alias("labels"))


@query("a20_centroids", "select batch, label, dim, round(avg(x), 6) as x from (select (vec_id % 4)::int as batch, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1)::int - 1 as dim from embeddings) group by all")
def _(spark, d):
    c = T.centroids(V.cells(spark, d), "batch", "label")
    return c.select("batch", "label", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("a21_argmax_columns", "select l_orderkey, l_linenumber, case when l_discount >= l_tax then 'l_discount' else 'l_tax' end as name from lineitem")
def _(spark, d):
    each = [F.struct(F.col(c).alias("v"), F.lit(-i).alias("t"), F.lit(c).alias("name")) for i, c in enumerate(("l_discount", "l_tax"))]
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(*each)["name"].alias("name"))


@query("a22_missing_share", "select lang, round(avg(case when quality is null then 1.0 else 0.0 end), 6) as share from documents left join (select distinct doc_id, quality from labels) using (doc_id) group by lang")
def _(spark, d):
    x = V.table(spark, d, "documents").select("doc_id", "lang").join(V.table(spark, d, "labels").select("doc_id", "quality").distinct(), "doc_id", "left")
    return x.groupBy("lang").agg(F.round(F.avg(F.col("quality").isNull().cast("double")), 6).alias("share"))


@query("w1_average_rank", sql("select dataset, method, rank() over (partition by dataset order by label_mean desc) + (count(*) over (partition by dataset, label_mean) - 1) / 2 as rank from scores_v", "scores_v"))
def _(spark, d):
    return V.scores(spark, d).select("dataset", "method", average_rank(F.col("label_mean"), "dataset", descending=True).alias("rank"))


@query("w3_pct_rank", sql("select dataset, method, round((rank() over (partition by dataset order by label_mean) + (count(*) over (partition by dataset, label_mean) - 1) / 2) / count(*) over (partition by dataset), 6) as rank from scores_v", "scores_v"))
def _(spark, d):
    return V.scores(spark, d).select("dataset", "method", F.round(percent_rank(F.col("label_mean"), "dataset"), 6).alias("rank"))


@query("w4_two_level_rank", sql("select method, round(avg(r), 6) as rank from (select method, rank() over (partition by dataset order by label_mean desc) + (count(*) over (partition by dataset, label_mean) - 1) / 2 as r from scores_v) group by method", "scores_v"))
def _(spark, d):
    return S.mean_rank(V.scores(spark, d), "dataset", "method", F.col("label_mean")).select("method", r6("rank"))


@query("w7_cumulative_sizes", sql("select slice_idx, sum(n) over (order by slice_idx)::bigint as upto from (select slice_idx, count(*) as n from slices group by slice_idx)", "slices"))
def _(spark, d):
    n = V.slices(spark, d).groupBy("slice_idx").agg(F.count("*").alias("n"))
    return n.select("slice_idx", F.sum("n").over(Window.orderBy("slice_idx").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))


@query("w9_transitions", sql("select slice_idx, label, n, coalesce(lead(n) over (partition by label order by slice_idx), 0)::bigint as next_n from (select slice_idx, label, count(*) as n from slices group by all)", "slices"))
def _(spark, d):
    n = V.slices(spark, d).groupBy("slice_idx", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("label").orderBy("slice_idx")
    return n.withColumn("next_n", F.coalesce(F.lead("n").over(w), F.lit(0).cast("long")))


@query("w10_diagonal_spearman", sql("+" + BRANDS + ", g as (select a.batch as a, b.batch as b, round(sum(a.score * b.score), 4) as value from brand_scores a join brand_scores b using (gene_id) group by all), r as (select a, rank() over (partition by a order by value desc) + (count(*) over (partition by a, value) - 1) / 2 as x, rank() over (partition by a order by abs(a - b)) + (count(*) over (partition by a, abs(a - b)) - 1) / 2 as y from g) select round(avg(rho), 6) as score from (select corr(x, y) as rho from r group by a)", "expr_dense"))
def _(spark, d):
    g = X.gram(brand_scores(spark, d)).select("a", "b", (-F.round("value", 4)).alias("value")).withColumn("gap", F.abs(F.col("a") - F.col("b")))
    return X.spearman(g, "value", "gap", "a").agg(F.round(F.avg("rho"), 6).alias("score"))


@query("k1_top_union", sql("+" + BRANDS + ", " + RANKED + " select distinct gene_id from ranked where r <= 5", "expr_dense"))
def _(spark, d):
    return X.top_union(brand_scores(spark, d), 5)


@query("k2_hvg_union_limit", sql("+" + BRANDS + ", " + RANKED + ", best as (select gene_id, min(r) as best from ranked group by gene_id), c as (select best, sum(count(*)) over (order by best) as c from best where best < 12 group by best), n as (select max(best) as n from c where c <= 12 or best = 1) select gene_id from best, n where best <= n", "expr_dense"))
def _(spark, d):
    return X.top_union_limit(brand_scores(spark, d), 12)


@query("k3_hvg_round_robin", sql("+" + BRANDS + ", " + RANKED + ", f as (select gene_id, min(r * 10 + batch) as m from ranked group by gene_id) select gene_id from (select gene_id, row_number() over (order by m, gene_id) as p from f) where p <= 12", "expr_dense"))
def _(spark, d):
    return X.round_robin(brand_scores(spark, d), 12)


@query("k6_rank_by_similarity", sql("+" + BRANDS + ", g as (select a.batch as a, b.batch as b, round(sum(a.score * b.score), 4) as value from brand_scores a join brand_scores b using (gene_id) group by all) select a, b, row_number() over (partition by a order by value desc, b)::int as rank from g where a <> b", "expr_dense"))
def _(spark, d):
    g = X.gram(brand_scores(spark, d)).withColumn("value", F.round("value", 4)).filter("a <> b")
    return g.select("a", "b", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("value"), "b")).alias("rank"))


@query("k9_best_of_each", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r = 1")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return V.table(spark, d, "orders").withColumn("r", F.row_number().over(w)).filter("r = 1").select("o_custkey", "o_orderkey")


@query("b1_jaccard", sql("+" + BRANDS + ", " + RANKED + ", t as (select * from ranked where r <= 8) select a.batch as a, b.batch as b, round(count(*) / (16 - count(*)), 6) as value from t a join t b using (gene_id) group by all", "expr_dense"))
def _(spark, d):
    return X.jaccard(brand_scores(spark, d), 8).select("a", "b", r6("value"))


@query("b2_cosine", sql("+" + BRANDS + ", t as (select a.batch as a, b.batch as b, a.score as s, b.score as t, row_number() over (partition by a.batch, b.batch order by a.score + b.score desc, gene_id) as r from brand_scores a join brand_scores b using (gene_id)) select a, b, round(sum(s * t) / sqrt(sum(s * s) * sum(t * t)), 6) as value from t where r <= 8 group by all", "expr_dense"))
def _(spark, d):
    return X.masked_cosine(brand_scores(spark, d), 8).select("a", "b", r6("value"))


@query("b3_gram", sql("+" + BRANDS + " select a.batch as a, b.batch as b, round(sum(a.score * b.score), 4) as value from brand_scores a join brand_scores b using (gene_id) group by all", "expr_dense"))
def _(spark, d):
    return X.gram(brand_scores(spark, d)).select("a", "b", F.round("value", 4).alias("value"))


@query("b5_precision_at_k", sql("+" + BRANDS + ", g as (select a.batch as a, b.batch as b, round(sum(a.score * b.score), 4) as value from brand_scores a join brand_scores b using (gene_id) group by all), t as (select a, b, row_number() over (partition by a order by value desc, b) as r from g where a <> b) select 2 as k, round(avg((a % 2 = b % 2)::int), 6) as precision from t where r <= 2", "expr_dense"))
def _(spark, d):
    g = X.gram(brand_scores(spark, d)).withColumn("value", F.round("value", 4))
    labels = g.select(F.col("a").alias("id"), (F.col("a") % 2).alias("label")).distinct()
    return X.precision_at(g, labels, 2).select("k", r6("precision"))


@query("b6_adjacency_top", sql("+" + BRANDS + ", g as (select a.batch as a, b.batch as b, round(sum(a.score * b.score), 4) as value from brand_scores a join brand_scores b using (gene_id) group by all), t as (select a, b, row_number() over (partition by a order by value desc, b) as r, count(*) over (partition by a) as n from g) select distinct i, j from (select a as i, b as j from t where r <= ceil(n * 0.5) union all select b, a from t where r <= ceil(n * 0.5))", "expr_dense"))
def _(spark, d):
    return X.adjacency_top(X.gram(brand_scores(spark, d)).withColumn("value", F.round("value", 4)), 0.5)


@query("b7_stairs", sql("+n as (select distinct slice_idx as i from slices) select a.i as i, b.i as j from n a join n b on b.i - a.i in (0, 1)", "slices"))
def _(spark, d):
    n = V.slices(spark, d).select(F.col("slice_idx").alias("i")).distinct()
    return n.select("i", F.explode(F.array(F.col("i"), F.col("i") + 1)).alias("j")).join(n.select(F.col("i").alias("j")), "j", "left_semi").select("i", "j")


@query("b8_star", sql("+n as (select distinct slice_idx as i from slices) select a.i as i, b.i as j from n a, n b where a.i = 1 or b.i = 1", "slices"))
def _(spark, d):
    n = V.slices(spark, d).select(F.col("slice_idx").alias("i")).distinct()
    return n.select(F.lit(1).alias("i"), F.col("i").alias("j")).union(n.select("i", F.lit(1))).distinct()


@query("u3_set_sizes", sql("+x as (select distinct gene_id, batch from expr_sparse) select a.batch as a, b.batch as b, count(*) as both from x a join x b using (gene_id) where a.batch < b.batch group by all", "expr_sparse"))
def _(spark, d):
    x = V.expr_sparse(spark, d).select("gene_id", "batch").distinct()
    y = x.select("gene_id", F.col("batch").alias("b"))
    return x.withColumnRenamed("batch", "a").join(y, "gene_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))


@query("u4_adjacency_union", sql("+n as (select distinct slice_idx as i from slices) select distinct i, j from (select a.i as i, b.i as j from n a join n b on b.i - a.i in (0, 1) union all select 1 as i, i as j from n)", "slices"))
def _(spark, d):
    n = V.slices(spark, d).select(F.col("slice_idx").alias("i")).distinct()
    return QUERIES["b7_stairs"](spark, d).union(n.select(F.lit(1), "i")).distinct()


@query("e13_pareto_front", sql("select dataset, method, label_mean, batch_mean from scores_v a where not exists (select 1 from scores_v b where a.dataset = b.dataset and b.label_mean >= a.label_mean and b.batch_mean >= a.batch_mean and (b.label_mean > a.label_mean or b.batch_mean > a.batch_mean))", "scores_v"))
def _(spark, d):
    return S.pareto_front(V.scores(spark, d), ("dataset",), ("label_mean", "batch_mean"))


@query("e15_friedman", sql("+r as (select method, rank() over (partition by dataset order by label_mean) + (count(*) over (partition by dataset, label_mean) - 1) / 2 as r from scores_v), m as (select avg(r) as m from r group by method), n as (select count(distinct dataset) as n, count(distinct method) as k from scores_v) select round(any_value(12 * n / (k * (k + 1))) * (sum(m * m) - any_value(k * (k + 1) * (k + 1) / 4)), 5) as chi2 from m, n", "scores_v"))
def _(spark, d):
    return S.friedman(V.scores(spark, d), "label_mean").select(F.round("chi2", 5).alias("chi2"))


@query("t1_grouping_sets", sql("+x as (select *, case when dataset % 2 = 0 then 'TS' else 'Batch' end as part from scores_v), p as (select method, coalesce(part, 'Total') as part, exp(avg(ln(label_mean))) as label, exp(avg(ln(batch_mean))) as batch from x group by grouping sets ((method, part), (method))) select method, part, round(label, 6) as label, round(batch, 6) as batch, round(sqrt(label * batch), 6) as both from p", "scores_v"))
def _(spark, d):
    s = V.scores(spark, d)
    ts = s.select("dataset", (F.col("dataset") % 2 == 0).alias("is_timeseries")).distinct()
    return S.results_table(s, ts).select("method", "part", r6("label"), r6("batch"), r6("both"))


@query("sn2_flow_prune", sql("+c as (select a, b, count(*) as n from pairs group by all), x as (select *, sum(n) over (partition by a) as o, row_number() over (partition by a order by n desc, b) as ra, row_number() over (partition by b order by n desc, a) as rb from c), f as (select * from x where n > 0.2 * o or ra <= 1 or rb <= 1) select a, b, n from f", "pairs"))
def _(spark, d):
    return S.flow_prune(V.pairs(spark, d))


@query("x1_nested_scores", sql("select dataset, method, label_mean from scores_v", "scores_v"))
def _(spark, d):
    nested = V.scores(spark, d).groupBy("dataset").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("method", F.struct("label_mean"))))).alias("json"))
    return nested.select("dataset", F.explode(F.from_json("json", "map<string, struct<label_mean: double>>")).alias("method", "s")).select("dataset", "method", "s.label_mean")


@query("sc8_matrix_roundtrip", sql("select gene_id, cell_id, value from expr_dense", "expr_dense"))
def _(spark, d):
    """The dense expressions as one map a gene (its cells' values) and back to long form."""
    e = V.expr_dense(spark, d).select("gene_id", F.struct("cell_id", "value").alias("p"))
    return e.groupBy("gene_id").agg(F.map_from_entries(F.collect_list("p")).alias("m")).select("gene_id", F.explode("m").alias("cell_id", "value"))


@query("l8_cell_ranger_scores")
def _(spark, d):
    return X.gene_scores(V.expr_sparse(spark, d), "cell_ranger")


@query("streaming_slice_counts", "select strftime(ts, '%Y-%m-%d') as start, event_type as label, count(*) as n from events group by all")
def _(spark, d):
    from tessera.streaming.slices import slice_counts

    return slice_counts(V.table(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))
