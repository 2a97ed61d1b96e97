"""The remaining selections, joins, aggregates, rankings, builders and evaluation tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.vectors import average_rank, gmean
from tessera.operators import expr as X
from tessera.operators import graph as G
from tessera.operators import knn as K
from tessera.operators import match as M
from tessera.operators import models as L
from tessera.operators import score as S
from tessera.operators import selectors as H
from tessera.operators import transfer as T
from tessera.plans.relational import BRANDS, brand_scores, r6
from tessera.plans.vector import EUCLID, near_sql, pairs_sql
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


# ---- selections ----


@query("f2_drop_by_columns", "select l_orderkey, l_linenumber from lineitem where l_returnflag <> 'R' and l_linestatus <> 'F'")
def _(spark, d):
    out = V.table(spark, d, "lineitem")
    for c, v in {"l_returnflag": "R", "l_linestatus": "F"}.items():
        out = out.filter(F.col(c) != v)
    return out.select("l_orderkey", "l_linenumber")


@query("f3_drop_nan", "select event_id, ln(value) as x from events where value > 0 and ln(value) > 1")
def _(spark, d):
    x = V.table(spark, d, "events").select("event_id", F.log("value").alias("x"))
    return x.filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.col("x") > 1))


@query("f7_drop_prefixes", sql("select cell_id, gene_id, value from expr_dense where gene_id not like 'Brand#1%' and gene_id not like 'Brand#2%'", "expr_dense"))
def _(spark, d):
    return X.drop_prefixes(V.expr_dense(spark, d), "Brand#1", "Brand#2").select("cell_id", "gene_id", "value")


@query("f9_select_datasets", "with n as (select p_brand, substr(p_brand, 1, 7) as prefix, count(*) as n, count(distinct p_type) as k from part group by p_brand), g as (select * from n where n > 5 and k >= 2) select p_brand as dataset from g where prefix in (select prefix from g group by prefix having count(*) >= 4)")
def _(spark, d):
    n = V.table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("k"))
    good = n.filter("n > 5 and k >= 2").withColumn("prefix", F.substring("p_brand", 1, 7))
    often = good.groupBy("prefix").count().filter("count >= 4").select("prefix")
    return good.join(often, "prefix", "left_semi").select(F.col("p_brand").alias("dataset"))


@query("f10_select_methods", sql("select dataset, method from scores_v where method in ('BUILDING', 'MACHINERY')", "scores_v"))
def _(spark, d):
    return V.scores(spark, d).filter(F.col("method").isin("BUILDING", "MACHINERY")).select("dataset", "method")


@query("f11_score_predicates", sql("select dataset, method, label_mean from scores_v where label_mean > 0.3 and dataset % 2 = 0", "scores_v"))
def _(spark, d):
    return V.scores(spark, d).filter((F.col("label_mean") > 0.3) & (F.col("dataset") % 2 == 0)).select("dataset", "method", "label_mean")


@query("f12_batch_index", "select event_id, dense_rank() over (order by first_id)::int as batch_idx from (select event_id, min(event_id) over (partition by event_type) as first_id from events)")
def _(spark, d):
    e = V.table(spark, d, "events").select("event_id", "event_type")
    order = e.groupBy("event_type").agg(F.min("event_id").alias("first_id")).withColumn("batch_idx", F.row_number().over(Window.orderBy("first_id")))  # one row a batch
    return e.join(F.broadcast(order), "event_type").select("event_id", "batch_idx")


@query("f14_subsample", "select vec_id as cell_id from embeddings order by md5('0:' || vec_id), vec_id limit 100")
def _(spark, d):
    return X.subsample(V.cells(spark, d), 100).select("cell_id")


@query("f17_subsample_share", "select vec_id as cell_id from embeddings where ('0x' || substr(md5('0:' || vec_id), 1, 8))::bigint / 4294967296.0 < 0.3")
def _(spark, d):
    return X.subsample_share(V.cells(spark, d), 0.3).select("cell_id")


@query("f15_bootstrap")
def _(spark, d):
    return X.bootstrap(V.cells(spark, d), 1.0, 3).groupBy("batch").agg(F.count("*").alias("n"))


@query("f19_sample_batches", "select cell_id, batch from (select vec_id as cell_id, (vec_id % 4)::int as batch, row_number() over (partition by vec_id % 4 order by md5('0:' || vec_id), vec_id) as r from embeddings) where r <= 40 and batch in (select b from (select distinct (vec_id % 4)::int as b from embeddings) order by md5('0:' || b), b limit 2)")
def _(spark, d):
    return X.sample_batches(V.cells(spark, d), 2, 40).select("cell_id", "batch")


@query("f21_select_slices", sql("+n as (select slice_idx, label, count(*) as n from slices where slice_idx <= 10 group by all), r as (select label, avg(rank() over (partition by slice_idx order by n desc) + (0)) over (partition by label) as m from n), t as (select label, avg(k) as m from (select label, rank() over (partition by slice_idx order by n desc) + (count(*) over (partition by slice_idx, n) - 1) / 2 as k from n) group by label), b as (select label from t order by m, label limit 3) select slice_idx, cell_id from slices where slice_idx <= 10 and label in (select label from b)", "slices").replace("r as (select label, avg(rank() over (partition by slice_idx order by n desc) + (0)) over (partition by label) as m from n), ", ""))
def _(spark, d):
    """Rows of the first ten slices with the three labels of the best mean rank by count."""
    s = V.slices(spark, d).filter("slice_idx <= 10")
    n = s.groupBy("slice_idx", "label").agg(F.count("*").alias("n"))
    top = n.withColumn("r", average_rank(F.col("n"), "slice_idx", descending=True)).groupBy("label").agg(F.avg("r").alias("m")).orderBy("m", "label").limit(3)
    return s.join(top.select("label"), "label", "left_semi").select("slice_idx", "cell_id")


@query("f22_cut_genes", sql("+top as (select gene_id, sum(value) as s from expr_dense group by gene_id order by s desc, gene_id limit 5) select cell_id, gene_id, value from expr_dense where gene_id in (select gene_id from top)", "expr_dense"))
def _(spark, d):
    e = V.expr_dense(spark, d)
    top = e.groupBy("gene_id").agg(F.sum("value").alias("s")).orderBy(F.desc("s"), "gene_id").limit(5)
    return e.join(top.select("gene_id"), "gene_id", "left_semi").select("cell_id", "gene_id", "value")


@query("f24_attach_column", "select vec_id as cell_id, n from embeddings join (select label, count(*) as n from embeddings group by label) using (label)")
def _(spark, d):
    c = V.cells(spark, d)
    return c.join(c.groupBy("label").agg(F.count("*").alias("n")), "label").select("cell_id", "n")


@query("f25_mask_labels", "select vec_id as cell_id, case when vec_id % 4 in (2, 3) then null else label end as label from embeddings")
def _(spark, d):
    return V.cells(spark, d).select("cell_id", F.when(~F.col("batch").isin(2, 3), F.col("label")).alias("label"))


@query("f26_edges_of_weight", sql("+" + near_sql() + " select i, j from p where r = 2", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    return K.knn(c, c, 3).filter("rank = 2").select("i", "j")


@query("f28_split_by_flag", sql("select case when dataset < 12 then 'TS' else 'Batch' end as part, count(*) as n from scores_v group by all", "scores_v"))
def _(spark, d):
    flag = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("dataset"), (F.col("n_nationkey") < 12).alias("ts"))
    return V.scores(spark, d).join(flag, "dataset").groupBy(F.when(F.col("ts"), "TS").otherwise("Batch").alias("part")).agg(F.count("*").alias("n"))


# ---- scalar work ----


@query("m2_expm1", "select event_id, round(exp(ln(1 + value)) - 1, 6) as x, round(ln(1 + value), 6) as y from events")
def _(spark, d):
    return V.table(spark, d, "events").select("event_id", F.round(F.expm1(F.log1p("value")), 6).alias("x"), F.round(F.log1p("value"), 6).alias("y"))


@query("m7_local_scaling", sql("+" + near_sql() + ", s as (select i, avg(d) as r from p where r <= 10 group by i) select p.i as i, p.j as j, round(1 - exp(-d * d / (a.r * b.r)), 6) as d from p join s a on p.i = a.i join s b on p.j = b.i where p.r <= 10", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    near = K.knn(c, c, 10)
    s = K.local_scale(near)
    return K.hubness(near.select("i", "j", "d"), s, s, "local_scaling").select("i", "j", r6("d"))


BELOW = "1 / (1 + exp(-1.702 * (d - {0}m) / {0}s))"
PROXIMITY = "1 - (1 - " + BELOW.format("i") + ") * (1 - " + BELOW.format("j") + ")"


@query("m7_mutual_proximity", sql("+" + near_sql() + ", w as (select i, j, d, avg(d) over (partition by i) as im, stddev_pop(d) over (partition by i) as \"is\", avg(d) over (partition by j) as jm, stddev_pop(d) over (partition by j) as js, count(*) over (partition by j) as n from p where r <= 10) select i, j, round(" + PROXIMITY.replace("is))", '"is"))') + ", 6) as d from w where n > 1", "cells_v"))
def _(spark, d):
    """From the distances to the ten nearest; a cell that is near to one other only has no distribution."""
    c = V.cells(spark, d)
    near = K.knn(c, c, 10).select("i", "j", "d")
    out = K.hubness(near.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("j"))).filter("n > 0"), near, near, "mutual_proximity")
    return out.filter("n > 1").select("i", "j", r6("d"))


@query("m7_proximity_between", sql("+" + pairs_sql(EUCLID, "a.batch = 0 and b.batch = 1", "x", "i") + ", w as (select i, j, d, r, avg(d) over (partition by i) as im, stddev_pop(d) over (partition by i) as \"is\", avg(d) over (partition by j) as jm, stddev_pop(d) over (partition by j) as js from x) select i, j, round(" + PROXIMITY.replace("is))", '"is"))') + ", 6) as d from w where r <= 10", "cells_v"))
def _(spark, d):
    """Between two batches, from each cell's distances to the whole other batch."""
    c = V.cells(spark, d)
    a, b = c.filter("batch = 0"), c.filter("batch = 1")
    return K.hubness(K.knn(a, b, 10).select("i", "j", "d"), K.distance_moments(a, b), K.distance_moments(b, a), "mutual_proximity").select("i", "j", r6("d"))


@query("m7_rank", sql("+" + near_sql() + " select i, j, rank() over (partition by i order by d) + (count(*) over (partition by i, d) - 1) / 2 as d from p where r <= 10", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    near = K.knn(c, c, 10).select("i", "j", "d")
    return K.hubness(near, near, near, "rank").select("i", "j", "d")


@query("m10_binarize", sql("select cell_id, gene_id, (row_number() over (partition by cell_id order by value desc, gene_id) <= 3)::int as x from expr_dense", "expr_dense"))
def _(spark, d):
    r = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("value"), "gene_id"))
    return V.expr_dense(spark, d).select("cell_id", "gene_id", (r <= 3).cast("int").alias("x"))


@query("m11_one_hot", "select vec_id as cell_id, (label = 0)::int as l0, (label = 1)::int as l1, (label = 2)::int as l2 from embeddings")
def _(spark, d):
    return V.cells(spark, d).select("cell_id", *[(F.col("label") == k).cast("int").alias(f"l{k}") for k in range(3)])


@query("m15_row_geomean", sql("select dataset, method, round(sqrt(label_mean * batch_mean), 6) as both from scores_v", "scores_v"))
def _(spark, d):
    return V.scores(spark, d).select("dataset", "method", F.round(F.sqrt(F.col("label_mean") * F.col("batch_mean")), 6).alias("both"))


@query("m17_strings", r"select p_partkey, substr(p_type, 1, 5) as head, split_part(p_name, ' ', 1) as first, regexp_extract(p_brand, '#\d+') as code, replace(p_brand, '#', '-') as dashed, strpos(p_name, ' ')::int as gap from part")
def _(spark, d):
    p = V.table(spark, d, "part")
    return p.select("p_partkey", F.substring("p_type", 1, 5).alias("head"), F.split("p_name", " ")[0].alias("first"), F.regexp_extract("p_brand", r"#\d+", 0).alias("code"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("dashed"), F.instr("p_name", " ").alias("gap"))


# ---- joins ----


@query("j3_chained_lookup", "select o_orderkey, (dense_rank() over (order by n_name) - 1)::int as code from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def _(spark, d):
    n = V.table(spark, d, "nation").withColumn("code", F.dense_rank().over(Window.orderBy("n_name")) - 1)  # 25 rows
    present = V.table(spark, d, "customer").join(V.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_nationkey")
    used = n.join(present.select("c_nationkey").distinct(), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").withColumn("code", F.dense_rank().over(Window.orderBy("n_name")) - 1)
    return present.join(F.broadcast(used), F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "code")


@query("j7_cross_batch_nearest", sql("+" + pairs_sql(EUCLID, "a.batch < b.batch", "x", "i, bj") + " select bi as a, bj as b, i, j, round(d, 6) as d from x where r = 1", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    left = c.select("cell_id", "vec", F.col("batch").alias("a")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(3)))).filter("a < b")
    right = c.select("cell_id", "vec", F.col("batch").alias("b"))
    near = K.knn(left.select("cell_id", "vec", "b"), right, 1, by=("b",))
    return near.join(c.select(F.col("cell_id").alias("i"), F.col("batch").alias("a")), "i").select("a", "b", "i", "j", r6("d"))


@query("j13_scaled_matches")
def _(spark, d):
    c = V.cells(spark, d)
    near = K.knn(c, c, 2, by=("batch",))
    return M.scaled(M.matched(c, M.stairs(c, (1,))), K.local_scale(near), 0.75, 0.25)


@query("j11_repeated_assignment")
def _(spark, d):
    c = V.cells(spark, d)
    return M.matched(c, M.stairs(c, (1,)), rounds=2)


@query("j22_confusion_relabel")
def _(spark, d):
    return L.relabelled(S.kni(V.cells(spark, d)).select(F.col("label").cast("string").alias("a"), F.col("vote").cast("string").alias("b")))


@query("j_semi_anti", "select c_custkey, (c_custkey in (select o_custkey from orders where o_totalprice > 100000))::int as big, (c_custkey not in (select o_custkey from orders))::int as idle from customer")
def _(spark, d):
    c, o = V.table(spark, d, "customer").select("c_custkey"), V.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    big = o.filter("o_totalprice > 100000").select("c_custkey").distinct().withColumn("big", F.lit(1))
    idle = c.join(o, "c_custkey", "left_anti").withColumn("idle", F.lit(1))
    return c.join(big, "c_custkey", "left").join(idle, "c_custkey", "left").select("c_custkey", F.coalesce("big", F.lit(0)).alias("big"), F.coalesce("idle", F.lit(0)).alias("idle"))


# ---- aggregates ----


@query("a2_pair_counts", sql("select a, b, count(*) as n from pairs group by all", "pairs"))
def _(spark, d):
    return V.pairs(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("a4_full_confusion", sql("+n as (select a, b, count(*) as n from pairs where a < 'p' group by all), l as (select a from n union select b from n) select x.a as a, y.a as b, coalesce(n, 0) as n from l x cross join l y left join n on n.a = x.a and n.b = y.a", "pairs"))
def _(spark, d):
    return S.confusion(V.pairs(spark, d).filter("a < 'p'"), "a", "b", full=True).select("a", "b", "n")


@query("a7_flag_shares", "select o_orderpriority as batch, round(avg((o_orderstatus = 'F')::int), 6) as f, round(avg((o_totalprice > 100000)::int), 6) as big, count(*) as n from orders group by all")
def _(spark, d):
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    return V.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("batch")).agg(share(F.col("o_orderstatus") == "F", "f"), share(F.col("o_totalprice") > 100000, "big"), F.count("*").alias("n"))


@query("a9_multi_key_gmean", "select l_returnflag, l_linestatus, round(exp(avg(ln(l_extendedprice))), 4) as g from lineitem where l_extendedprice > 0 group by all")
def _(spark, d):
    return V.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(gmean("l_extendedprice"), 4).alias("g"))


@query("a14_mode_smallest", "select user_id, label from (select *, row_number() over (partition by user_id order by n desc, label) as r from (select user_id, event_type as label, count(*) as n from events group by all)) where r = 1")
def _(spark, d):
    return V.table(spark, d, "events").groupBy("user_id").agg(F.mode("event_type", True).alias("label"))


@query("a15_mean_over_all", sql("+n as (select batch, count(distinct cell_id) as n from expr_sparse group by batch) select batch, gene_id, round(sum(value) / any_value(n), 6) as mean from expr_sparse join n using (batch) group by batch, gene_id", "expr_sparse"))
def _(spark, d):
    return X.gene_scores(V.expr_sparse(spark, d), "mean_raw").select("batch", "gene_id", F.round("score", 6).alias("mean"))


@query("a23_mean_by_method", sql("select method, round(avg(label_mean), 6) as label_mean, round(avg(batch_mean), 6) as batch_mean from scores_v group by method", "scores_v"))
def _(spark, d):
    return V.scores(spark, d).groupBy("method").agg(F.round(F.avg("label_mean"), 6).alias("label_mean"), F.round(F.avg("batch_mean"), 6).alias("batch_mean"))


@query("a24_metric_split", sql("select dataset, case when metric = 'batch_mean' then 'batch' else 'bio' end as kind, round(exp(avg(ln(value))), 6) as g from (select dataset, 'label_mean' as metric, label_mean as value from scores_v union all select dataset, 'batch_mean', batch_mean from scores_v) group by all", "scores_v"))
def _(spark, d):
    long = V.scores(spark, d).unpivot(["dataset"], ["label_mean", "batch_mean"], "metric", "value")
    return long.groupBy("dataset", F.when(F.col("metric").isin("batch_mean"), "batch").otherwise("bio").alias("kind")).agg(F.round(gmean("value"), 6).alias("g"))


# ---- ranks and tops ----


@query("w2_dense_rank", sql("select dataset, method, dense_rank() over (partition by dataset order by round(label_mean, 1) desc)::int as rank from scores_v", "scores_v"))
def _(spark, d):
    w = Window.partitionBy("dataset").orderBy(F.desc(F.round("label_mean", 1)))
    return V.scores(spark, d).select("dataset", "method", F.dense_rank().over(w).alias("rank"))


@query("w11_decay", sql("select distinct slice_idx, pow(2, -abs(5 - slice_idx)) as alpha from slices", "slices"))
def _(spark, d):
    return V.slices(spark, d).select("slice_idx", F.pow(F.lit(2.0), -F.abs(5 - F.col("slice_idx"))).alias("alpha")).distinct()


@query("k7_rank_in_prefix", "with t as (select p_brand, substr(p_brand, 1, 7) as prefix, avg(p_retailprice) as m from part group by p_brand) select p_brand, prefix, row_number() over (partition by prefix order by round(m, 6) desc, p_brand)::int as rank from t")
def _(spark, d):
    t = V.table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("m")).withColumn("prefix", F.substring("p_brand", 1, 7))
    return t.select("p_brand", "prefix", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc(F.round("m", 6)), "p_brand")).alias("rank"))


@query("k8_largest", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 3")
def _(spark, d):
    return V.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).select("o_orderkey", "o_totalprice")


@query("k10_method_order", "select m as method, row_number() over (order by case when m = 'FURNITURE' then 0 when m like 'B%' then 1 else 2 end, m)::int as position from (select distinct c_mktsegment as m from customer)")
def _(spark, d):
    m = V.table(spark, d, "customer").select(F.col("c_mktsegment").alias("method")).distinct()
    key = F.when(F.col("method") == "FURNITURE", 0).when(F.col("method").startswith("B"), 1).otherwise(2)
    return m.select("method", F.row_number().over(Window.orderBy(key, "method")).alias("position"))  # one row a method


@query("k13_random_non_neighbours")
def _(spark, d):
    """For each cell four cells of its batch that are none of its neighbours: ten in a row, from a drawn place on, of the batch
    in the order of a hash; at most six of them are the cell and its neighbours."""
    c = V.cells(spark, d)
    near = K.knn(c, c, 5).select("i", "j")
    ids = c.select("cell_id", (F.row_number().over(Window.partitionBy("batch").orderBy(F.xxhash64("cell_id"), "cell_id")) - 1).alias("at"), "batch")
    n = ids.groupBy("batch").agg(F.count("*").alias("n"))
    draws = ids.join(n, "batch").select(F.col("cell_id").alias("i"), "batch", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.pmod(F.xxhash64("cell_id", F.lit(1)), F.col("n")) + k)).alias("at"), "n")
    draws = draws.withColumn("at", F.col("at") % F.col("n"))
    found = draws.join(ids.select("batch", "at", F.col("cell_id").alias("j")), ["batch", "at"]).filter("i <> j").select("i", "j").distinct().join(near, ["i", "j"], "left_anti")
    r = F.row_number().over(Window.partitionBy("i").orderBy(F.xxhash64("i", "j"), "j"))
    return found.withColumn("r", r).filter("r <= 4").select("i", "j")


# ---- sets and builders ----


@query("u1_union_shared_columns", "select c_name as name, c_nationkey as nation, c_acctbal as balance from customer union all select s_name, s_nationkey, s_acctbal from supplier")
def _(spark, d):
    a = V.table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    b = V.table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    shared = [c for c in a.columns if c in b.columns]
    return a.select(*shared).unionByName(b.select(*shared))


@query("u5_difference", "select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 45")
def _(spark, d):
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(V.table(spark, d, "lineitem").filter("l_quantity > 45").select("l_partkey"))


@query("u6_label_universe", sql("select distinct label from slices", "slices"))
def _(spark, d):
    return V.slices(spark, d).select("label").distinct()


@query("b4_matrix_map", sql("+" + BRANDS + ", g as (select a.batch as a, b.batch as b, round(sum(a.score * b.score), 4) as value from brand_scores a join brand_scores b using (gene_id) where a.batch <> b.batch group by all), m as (select round(max(value) * 1.05, 3) as v from g) select a, b, value from g union all select batch, batch, v from (select distinct batch from brand_scores), m", "expr_dense"))
def _(spark, d):
    """All pairs of batches by one metric; a batch with itself gets 1.05 times the largest."""
    g = X.gram(brand_scores(spark, d)).filter("a <> b").withColumn("value", F.round("value", 4))
    most = g.agg(F.round(F.max("value") * 1.05, 3).alias("value"))
    return g.union(g.select(F.col("a").alias("x")).distinct().crossJoin(most).select("x", "x", "value"))  # most: one row


@query("b9_dynamic_threshold")
def _(spark, d):
    return L.connecting_threshold(X.gram(brand_scores(spark, d)).filter("a <> b"))


TENTHS = """+q as (select cell_id % 10 as batch, gene_id, sum(value) as s from expr_dense group by all), z as (select cell_id % 10 as batch, count(distinct cell_id) as n from expr_dense group by all),
    m as materialized (select a.batch as i, b.batch as j, round(sum(a.s / x.n * b.s / y.n), 3) as v from q a join q b using (gene_id) join z x on x.batch = a.batch join z y on y.batch = b.batch group by all), """


def tenths(spark, d):
    """Similarity of ten groups of cells: a, b, value."""
    e = V.expr_dense(spark, d).withColumn("batch", F.col("cell_id") % 10)
    return X.gram(X.gene_scores(e, "mean_raw")).withColumn("value", F.round("value", 3))


def rank_sql(c: str, part: str) -> str:
    by = f"partition by {part} " if part else ""
    return f"rank() over ({by}order by {c}) + (count(*) over (partition by {part + ', ' if part else ''}{c}) - 1) / 2"


@query("w10_side_spearman", sql(TENTHS + f"s as (select i, j, v, abs(i - j) as gap, 1 as side from m where j >= i union all select i, j, v, abs(i - j), 0 from m where j <= i), r as (select i, side, {rank_sql('v', 'i, side')} as x, {rank_sql('gap', 'i, side')} as y from s), c as (select corr(x, y) as rho from r group by i, side having count(*) > 1) select round(avg(rho), 6) as score from c where not isnan(rho)", "expr_dense"))
def _(spark, d):
    return S.side_spearman(tenths(spark, d)).select(r6("score"))


@query("w10_upper_spearman", sql(TENTHS + f"r as (select {rank_sql('v', '')} as x, {rank_sql('j - i', '')} as y from m where i < j) select round(corr(x, y), 6) as score from r", "expr_dense"))
def _(spark, d):
    return S.upper_spearman(tenths(spark, d)).select(r6("score"))


@query("w10_monotone_triangles", sql(TENTHS + "t as (select a.v, x.v as d, y.v as l, x.v > a.v and y.v > a.v as good from m a join m x on x.i = a.i + 1 and x.j = a.j join m y on y.i = a.i and y.j = a.j - 1 where a.j - a.i >= 2) select round(avg(good::int), 6) as share, round(sum(case when good then 0 else greatest(d - v, 0) + greatest(l - v, 0) end), 2) as error from t", "expr_dense"))
def _(spark, d):
    return S.monotone_triangles(tenths(spark, d)).select(r6("share"), F.round("error", 2).alias("error"))


@query("w10_order_pearson", sql(TENTHS + "r as (select row_number() over (partition by i order by v desc, j) - 1 as x, j - i - 1 as y from m where j > i and i < 9 union all select row_number() over (partition by i order by v, j) - 1, j from m where j < i and i < 9) select round(corr(x, y), 6) as score from r", "expr_dense"))
def _(spark, d):
    return S.order_pearson(tenths(spark, d)).select(r6("score"))


# ---- graphs, transfer, reduction ----


@query("g7_standardized_graph")
def _(spark, d):
    return G.integrate(L.standardized(V.cells(spark, d), "batch"))


@query("g11_assignment_kernel")
def _(spark, d):
    """A kernel of shortest paths of any length from the query set, over the graph of all batches."""
    c = V.cells(spark, d)
    e = G.linear_assignment_integrate(c, 5)
    paths = G.shortest_paths(e, c.filter("cell_id % 50 = 0").select("cell_id"))
    return G.gaussian(paths.select(F.col("source").alias("i"), F.col("node").alias("j"), "d"))


@query("l2_pca_per_batch")
def _(spark, d):
    return L.pca_per_batch(V.cells(spark, d), 5)


@query("l9_mean_scores", sql("+n as (select batch, count(distinct cell_id) as n from expr_dense group by batch), x as (select batch, gene_id, ln(1 + value * 1e4 / sum(value) over (partition by cell_id)) as v from expr_dense) select batch, gene_id, round(sum(v) / any_value(n), 6) as score from x join n using (batch) group by batch, gene_id", "expr_dense"))
def _(spark, d):
    return X.gene_scores(V.expr_dense(spark, d), "mean").select("batch", "gene_id", r6("score"))


@query("l10_residual_scores", sql("+" + BRANDS + ", x as (select batch, gene_id, floor(ln(score) / 0.25)::int as bin, ln(score) as v from brand_scores), q as (select bin, quantile_cont(v, 0.5) as m, stddev_pop(v) as s from x group by bin) select batch, gene_id, case when s > 0 then round((v - m) / s, 5) end as score from x join q using (bin)", "expr_dense"))
def _(spark, d):
    s = brand_scores(spark, d).select(F.concat_ws("|", F.col("batch").cast("string"), "gene_id").alias("gene_id"), F.col("score").alias("mean"), F.col("score").alias("dispersion"))
    part = F.split("gene_id", r"\|")
    return X.residual_scores(s).select(part[0].cast("int").alias("batch"), part[1].alias("gene_id"), F.round("score", 5).alias("score"))


@query("l9_standardised_variance", sql("""+n as (select batch, count(distinct cell_id) as n from expr_dense group by batch),
    g as (select batch, gene_id, any_value(n) as n, sum(value) / any_value(n) as mean, (sum(value * value) - sum(value) * sum(value) / any_value(n)) / (any_value(n) - 1) as var from expr_dense join n using (batch) group by batch, gene_id),
    v as materialized (select *, log10(mean) as x, log10(var) as y, count(*) over (partition by batch) as m from g where var > 0 and mean > 0),
    p as (select a.batch, a.gene_id, b.x - a.x as u, b.y, row_number() over (partition by a.batch, a.gene_id order by abs(b.x - a.x)) as r, least(a.m, greatest(3, floor(0.3 * a.m + 1e-5))) as q from v a join v b using (batch)),
    h as (select *, max(case when r <= q then abs(u) end) over (partition by batch, gene_id) as h from p),
    w as (select batch, gene_id, y, u / h as u, pow(1 - pow(abs(u) / h, 3), 3) as w from h where abs(u) <= h),
    s as (select batch, gene_id, sum(w) as a, sum(w * u) as b, sum(w * u * u) as c, sum(w * pow(u, 3)) as d, sum(w * pow(u, 4)) as e, sum(w * y) as t, sum(w * u * y) as tu, sum(w * u * u * y) as tuu from w group by all),
    f as (select batch, gene_id, sqrt(pow(10, (t * (c * e - d * d) - b * (tu * e - d * tuu) + c * (tu * d - c * tuu)) / (a * (c * e - d * d) - b * (b * e - d * c) + c * (b * d - c * c)))) as dev from s),
    k as (select batch, gene_id, sum(least(value, mean + sqrt(n) * dev)) as c, sum(pow(least(value, mean + sqrt(n) * dev), 2)) as cc from expr_dense join g using (batch, gene_id) join f using (batch, gene_id) group by all)
    select batch, gene_id, round(coalesce((n * mean * mean + cc - 2 * c * mean) / ((n - 1) * dev * dev), 0), 5) as score from g left join f using (batch, gene_id) left join k using (batch, gene_id)""", "expr_dense"))
def _(spark, d):
    e = V.expr_dense(spark, d)
    return H.standardised_variance(e, e.select("batch", "cell_id")).select("batch", "gene_id", F.round("score", 5).alias("score"))


@query("l8_cell_ranger_log", sql("""+n as (select batch, count(distinct cell_id) as n from expr_dense group by batch), t as (select *, sum(value) over (partition by batch, cell_id) as depth, sum(value) over (partition by batch, gene_id) as total from expr_dense),
    g as materialized (select batch, gene_id, sum(ln(1 + value * 1e4 / depth)) as s, sum(pow(ln(1 + value * 1e4 / depth), 2)) as ss, any_value(n) as n from t join n using (batch) where total >= 3 group by batch, gene_id),
    d as materialized (select batch, gene_id, s / n as mean, (ss - s * s / n) / (n - 1) / (s / n) as d from g), q as (select batch, quantile_cont(mean, [0.25, 0.5, 0.75]) as cuts from d group by batch),
    b as materialized (select batch, gene_id, d, len(list_filter(cuts, lambda c: mean > c)) as bin from d join q using (batch)), m as (select batch, bin, quantile_cont(d, 0.5) as m from b group by all),
    o as (select batch, bin, quantile_cont(abs(d - m), 0.5) / 0.6744897501960817 as mad from b join m using (batch, bin) group by all),
    r as (select batch, gene_id, case when mad > 0 then (d - m) / mad end as score from b join m using (batch, bin) join o using (batch, bin))
    select batch, gene_id, round(score, 5) as score, score is not null and row_number() over (partition by batch order by score desc nulls last, gene_id) <= 10 as selected from r""", "expr_dense"))
def _(spark, d):
    e = V.expr_dense(spark, d)
    return H.cell_ranger(e, e.select("batch", "cell_id"), 10, cuts=(25, 50, 75)).select("batch", "gene_id", F.round("score", 5).alias("score"), "selected")


@query("l10_dispersion_residuals")
def _(spark, d):
    s = X.gene_stats(X.normalized(V.expr_dense(spark, d), log=False))
    return H.dispersion_residuals(s, high=9.0, width=0.05).select("batch", "gene_id", F.round("score", 6).alias("score"))


@query("l11_preprocess")
def _(spark, d):
    """Even batches, gene scores, the union of their best genes, and the expressions cut to these."""
    e = V.expr_dense(spark, d)
    even = X.even_batches(e.select("cell_id", "batch").distinct())
    e = e.join(even.select("cell_id"), "cell_id", "left_semi")
    genes = X.top_union_limit(X.gene_scores(e, "dispersion"), 12)
    return X.normalized(e.join(genes, "gene_id", "left_semi"))


@query("lt2_diffuse_on_paths")
def _(spark, d):
    """Labels spread over a kernel of shortest paths on the neighbour graph (all pairs, of any length)."""
    c = V.cells(spark, d)
    e = K.symmetric(K.knn(c, c, 4)).select("i", "j", F.col("d").alias("weight"))
    paths = G.shortest_paths(e, c.select("cell_id"))
    w = G.gaussian(paths.filter("source <> node").select(F.col("source").alias("i"), F.col("node").alias("j"), "d"))
    return G.spread_labels(w, c.select("cell_id", F.when(F.col("batch") == 0, F.col("label")).alias("label")), rounds=10)


@query("lt7_corrected_diffusion")
def _(spark, d):
    c = G.stored(T.combat(V.cells(spark, d)))  # found once, read by every neighbour search
    w = G.gaussian(K.symmetric(K.knn(c, c, 8)))
    return G.spread_labels(w, c.select("cell_id", F.when(F.col("batch") < 2, F.col("label")).alias("label")), rounds=10)


@query("lt8_mixture_em")
def _(spark, d):
    """Clusters of the positions of aligned batches, each batch a view of them; labels of the first batch to start with."""
    c = T.pca(V.cells(spark, d), 4)
    at = G.cut(M.aligned(c).join(c.select("cell_id", "label", "vec"), "cell_id"))
    views = [at.filter(F.col("batch") == b).select(F.col("position").cast("long").alias("cell_id"), "vec") for b in range(4)]
    return L.paired_mixture(views, at.filter("batch = 0").select(F.col("position").cast("long").alias("cell_id"), F.col("label").alias("cluster")))


@query("lt11_paired_centres", sql("+h as (select cell_id, label, batch, vec[1:16] as a, vec[17:32] as b from cells_v), ca as (select label, list(m order by dim) as a from (select label, dim, avg(x) as m from (select label, unnest(a) as x, generate_subscripts(a, 1) as dim from h where batch = 0) group by all) group by label), cb as (select label, list(m order by dim) as b from (select label, dim, avg(x) as m from (select label, unnest(b) as x, generate_subscripts(b, 1) as dim from h where batch = 0) group by all) group by label), x as (select cell_id, 1 as view, ca.label as c, " + EUCLID.format(a="h.a", b="ca.a") + " as d from h, ca union all select cell_id, 2, cb.label, " + EUCLID.format(a="h.b", b="cb.b") + " as d from h, cb), n as (select * from (select *, row_number() over (partition by cell_id, view order by d, c) as r from x) where r = 1) select cell_id, arg_min(c, d)::bigint as cluster, count(distinct c) > 1 as disagree from n group by cell_id", "cells_v"))
def _(spark, d):
    """The nearest centre of the first batch's labels over two views (halves of the vectors), and whether the views differ."""
    c = V.cells(spark, d)
    views = [c.withColumn("vec", F.slice("vec", start, 16)) for start in (1, 17)]
    centres = [T.centroids(v.filter("batch = 0"), "label").select(F.col("label").alias("cluster"), "vec") for v in views]
    return T.paired_assign(views, centres)


@query("lt10_ensemble")
def _(spark, d):
    c = V.cells(spark, d)
    a = T.copy_labels(c, 0, 1).withColumn("source", F.lit(0))
    b = T.label_knn(c.filter("batch = 1"), c.filter("batch = 0")).withColumn("source", F.lit(1))
    k = T.label_knn(c.filter("batch = 1"), c.filter("batch = 2")).withColumn("source", F.lit(2))
    return T.majority(a.union(b).union(k), "cell_id", "source", "label")


@query("r3_scanorama")
def _(spark, d):
    """Batches joined from the best match on."""
    return T.scanorama(V.cells(spark, d)).select("cell_id", "batch", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


# ---- evaluation ----


@query("e7_accuracy", sql("+" + near_sql() + " select round(avg((li = lj)::int), 6) as accuracy from p where r = 1", "cells_v"))
def _(spark, d):
    return S.label_agreement(V.cells(spark, d), 1).select(F.round("agreement", 6).alias("accuracy"))


@query("e9_score_rows")
def _(spark, d):
    """dataset, method, label and batch scores of two methods on one table."""
    out = None
    for name, c in (("none", V.cells(spark, d)), ("combat", G.stored(T.combat(V.cells(spark, d))))):
        near = G.stored(K.knn(c, c, 16).select("i", "j", "d"))  # found once for both scores
        y = S.knn_cross_validation(c, among=near).select(F.col("mean").alias("label_mean"), F.col("std").alias("label_std"))
        b = S.knn_cross_validation(c, "batch", invert=True, among=near).select(F.col("mean").alias("batch_mean"), F.col("std").alias("batch_std"))
        row = y.crossJoin(b).select(F.lit("embeddings").alias("dataset"), F.lit(name).alias("method"), "*")  # one row each
        out = row if out is None else out.union(row)
    return out


@query("e10_linear_score")
def _(spark, d):
    return L.linear_accuracy(V.cells(spark, d))


@query("e10_linear_label_score")
def _(spark, d):
    return L.linear_label_score(V.cells(spark, d)).select(r6("score"))


@query("e10_linear_batch_score")
def _(spark, d):
    return L.linear_batch_score(V.cells(spark, d)).select(r6("score"))


@query("sn1_sankey_nodes", "select distinct label || '|' || b as node from (select label, vec_id % 4 as b from embeddings)")
def _(spark, d):
    return V.cells(spark, d).select(F.concat_ws("|", F.col("label").cast("string"), F.col("batch").cast("string")).alias("node")).distinct()


@query("sn1_sankey_links")
def _(spark, d):
    """Links between the labels of consecutive aligned batches: batch, a, b, n."""
    c = V.cells(spark, d)
    at = M.aligned(c).join(c.select("cell_id", "label"), "cell_id").select("batch", "position", "label")
    nxt = at.select((F.col("batch") - 1).alias("batch"), "position", F.col("label").alias("b"))
    return at.join(nxt, ["batch", "position"]).groupBy("batch", F.col("label").alias("a"), "b").agg(F.count("*").alias("n"))


PRUNED = """+placed as materialized (select batch, label::varchar as label, row_number() over (partition by batch order by cell_id) as position from cells_v), c as (select x.batch, x.label as a, y.label as b, count(*) as n from placed x join placed y on y.batch = x.batch + 1 and y.position = x.position group by all), w as (select *, sum(n) over (partition by batch, a) as o, row_number() over (partition by batch, a order by n desc, b) as ra, row_number() over (partition by batch, b order by n desc, a) as rb from c), f as (select * from w where n > 0.11 * o), l as materialized (select * from f union select * from w where ra = 1 and (batch, a) not in (select batch, a from f) union select * from w where rb = 1 and (batch, b) not in (select batch, b from f)), e as (select a as label, batch from l union select b, batch + 1 from l), nodes as materialized (select row_number() over (order by label, batch) - 1 as node, label, batch from e)"""


def _positions(spark, d):
    """Cells of a batch in the order of their ids: the position pairs them with the next batch's."""
    return V.cells(spark, d).select("batch", "label", F.row_number().over(Window.partitionBy("batch").orderBy("cell_id")).alias("position"))


@query("sn1_pruned_links", sql(PRUNED + " select x.node as source, y.node as target, n as value from l join nodes x on x.label = a and x.batch = l.batch join nodes y on y.label = b and y.batch = l.batch + 1", "cells_v"))
def _(spark, d):
    return S.sankey(_positions(spark, d), 0.11)[1]


@query("sn1_pruned_nodes", sql(PRUNED + " select * from nodes", "cells_v"))
def _(spark, d):
    return S.sankey(_positions(spark, d), 0.11)[0]


@query("sn4_ari_per_batch", "with n as (select (vec_id % 4)::int as batch, label as a, vec_id % 7 as b, count(*) as n from embeddings where label is not null group by all), x as (select batch, sum(n * (n - 1) / 2) as nij, sum(n) as t from n group by batch), a as (select batch, sum(n * (n - 1) / 2) as na from (select batch, sum(n) as n from n group by batch, a) group by batch), b as (select batch, sum(n * (n - 1) / 2) as nb from (select batch, sum(n) as n from n group by batch, b) group by batch) select batch, round((nij - na * nb / (t * (t - 1) / 2)) / ((na + nb) / 2 - na * nb / (t * (t - 1) / 2)), 6) as ari from x join a using (batch) join b using (batch)")
def _(spark, d):
    return S.adjusted_rand_by(V.cells(spark, d).withColumn("other", F.col("cell_id") % 7), "label", "other").select("batch", r6("ari"))


DATASETS = {"customer": ("c_nationkey", "c_mktsegment"), "orders": ("o_orderpriority", "o_orderstatus"), "lineitem": ("l_linestatus", "l_returnflag"), "events": ("user_id", "event_type"), "documents": ("source", "lang")}


@query("sc1_dataset_maps", " union all ".join(f"select '{t}' as dataset, {b}::varchar as batch, {c}::varchar as label, false as timeseries, count(*) as n from {t} group by all" for t, (b, c) in DATASETS.items()))
def _(spark, d):
    out = None
    for df in V.read_datasets(spark, d, DATASETS).values():
        part = df.groupBy("dataset", F.col("batch").cast("string").alias("batch"), F.col("label").cast("string").alias("label"), "timeseries").agg(F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out


@query("sc2_slices_over_99", " union all ".join(f"select '{t}' as dataset, batch, label, n, true as timeseries from (select {b}::varchar as batch, {c}::varchar as label, count(*) as n, sum(count(*)) over (partition by {b}) as t from {t} where {c} is not null group by {b}, {c}) where t > 99" for t, (b, c) in DATASETS.items()))
def _(spark, d):
    out = None
    for df in V.read_datasets(spark, d, DATASETS, timeseries=True, drop_missing=True, min_cells=100).values():
        part = df.groupBy("dataset", F.col("batch").cast("string").alias("batch"), F.col("label").cast("string").alias("label"), "timeseries").agg(F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out


SAMPLED = "+g as materialized (select *, count(*) over (partition by cell_id) as genes from expr_sparse), c as (select cell_id, batch, row_number() over (partition by batch order by md5('0:' || cell_id), cell_id) as r from (select distinct cell_id, batch from g where genes >= 3 and label <> 'MACHINERY')), s as materialized (select g.* from g join c using (cell_id, batch) where r <= 100)"


@query("sc7_sampled_cells", sql(SAMPLED + " select cell_id, gene_id, batch, label, value from s", "expr_sparse"))
def _(spark, d):
    return X.sampled_cells(V.expr_sparse(spark, d), 3, {"label": ["MACHINERY"]}, 100).select("cell_id", "gene_id", "batch", "label", "value")


@query("sc10_sampled_scores", sql(SAMPLED + ", n as (select batch, count(distinct cell_id) as n from s group by batch) select batch, gene_id, round(sum(value) / any_value(n), 6) as score from s join n using (batch) group by batch, gene_id", "expr_sparse"))
def _(spark, d):
    """One sample a batch without its unlabelled cells, and its gene scores."""
    s = X.sampled_cells(V.expr_sparse(spark, d), 3, {"label": ["MACHINERY"]}, 100)
    return X.gene_scores(s, "mean_raw").select("batch", "gene_id", r6("score"))


@query("t2_rank_and_gmean", sql("+r as (select method, rank() over (partition by dataset order by label_mean desc) + (count(*) over (partition by dataset, label_mean) - 1) / 2 as r, label_mean, batch_mean from scores_v) select method, round(avg(r), 6) as rank, round(exp(avg(ln(sqrt(label_mean * batch_mean)))), 6) as both from r group by method", "scores_v"))
def _(spark, d):
    s = V.scores(spark, d)
    ranks = S.mean_rank(s, "dataset", "method", F.col("label_mean"))
    return ranks.join(s.groupBy("method").agg(gmean(F.sqrt(F.col("label_mean") * F.col("batch_mean"))).alias("both")), "method").select("method", r6("rank"), r6("both"))


@query("t4_variance_text", sql("select method, format('{:.2f} ± {:.2f}', avg(label_mean), stddev_pop(label_mean)) as text from scores_v group by method", "scores_v"))
def _(spark, d):
    return V.scores(spark, d).groupBy("method").agg(F.format_string("%.2f ± %.2f", F.avg("label_mean"), F.stddev_pop("label_mean")).alias("text"))


@query("t7_similarity_grid", sql("+" + BRANDS + ", ranked as (select *, row_number() over (partition by batch order by score desc, gene_id) as r from brand_scores), n as (select unnest([4, 8]) as n), t as (select n, batch, gene_id from ranked, n where r <= n) select a.n as genes, a.batch as a, b.batch as b, round(count(*) / (2 * any_value(a.n) - count(*)), 6) as value from t a join t b on a.n = b.n and a.gene_id = b.gene_id group by a.n, a.batch, b.batch", "expr_dense"))
def _(spark, d):
    s, out = brand_scores(spark, d), None
    for n in (4, 8):
        row = X.jaccard(s, n).select(F.lit(n).alias("genes"), "a", "b", r6("value"))
        out = row if out is None else out.union(row)
    return out


@query("o1_grid_search")
def _(spark, d):
    """k, score of label agreement for a grid of k; the best first."""
    out = S.label_agreements(V.cells(spark, d), (3, 5, 9))
    return out.orderBy(F.desc("score"), "k")


@query("o1_successive_halving")
def _(spark, d):
    """Eighteen points (k and metric) on a ninth, a third and all of the cells."""
    k = spark.range(2, 11).select(F.col("id").cast("int").alias("k"), F.explode(F.array(F.lit("euclidean"), F.lit("cosine"))).alias("metric"))
    points = k.select(F.concat_ws("-", "metric", F.format_string("%02d", "k")).alias("point"), "k", "metric")
    return S.successive_halving(V.cells(spark, d), points, S.agreement_grid).select("point", "round", "cells", r6("score"))
