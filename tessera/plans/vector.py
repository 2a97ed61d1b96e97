"""Queries over vectors: neighbours, matches, graphs, scores and label transfer, with the same in DuckDB SQL where it can."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.vectors import euclidean, rotated_all
from tessera.operators import descent as D
from tessera.operators import graph as G
from tessera.operators import knn as K
from tessera.operators import match as M
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


EUCLID = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1] * x[2]))"
COSINE = f"1 - {DOT} / (sqrt({DOT.replace('{b}', '{a}')}) * sqrt({DOT.replace('{a}', '{b}')}))"


def pairs_sql(metric: str = EUCLID, where: str = "a.cell_id <> b.cell_id", name: str = "p", part: str = "a.cell_id") -> str:
    """CTE of all ranked pairs: i, j, d, batches and labels, r within `part`."""
    d = metric.format(a="a.vec", b="b.vec")
    return f"{name}0 as materialized (select a.cell_id as i, b.cell_id as j, {d} as d, a.batch as bi, b.batch as bj, a.label as li, b.label as lj from cells_v a, cells_v b where {where}), {name} as materialized (select *, row_number() over (partition by {part} order by d, j) as r from {name}0)"


def near_sql(metric: str = EUCLID, where: str = "a.cell_id <> b.cell_id", part: str = "i") -> str:
    return pairs_sql(metric, where, "p", part)


def d6(c: str = "d"):
    return F.round(c, 6).alias(c)


@query("e1_label_agreement", sql("+" + near_sql() + " select round(avg((li = lj)::int), 6) as agreement from p where r <= 5", "cells_v"))
def _(spark, d):
    return S.label_agreement(V.cells(spark, d)).select(F.round("agreement", 6).alias("agreement"))


@query("e2_batch_mixing", sql("+" + near_sql() + " select round(-avg((bi = bj)::int), 6) as mixing from p where r <= 5", "cells_v"))
def _(spark, d):
    return S.label_agreement(V.cells(spark, d), 5, "batch").select(F.round(-F.col("agreement"), 6).alias("mixing"))


@query("e4_paired_scores", sql("+" + pairs_sql(EUCLID, "a.cell_id <> b.cell_id and abs(a.batch - b.batch) <= 1", "q", "i") + ", w as (select x.i as w, q.*, row_number() over (partition by x.i, q.i order by d, j) as rw from q join (values (0), (1), (2)) x(i) on q.bi in (x.i, x.i + 1) and q.bj in (x.i, x.i + 1)) select w::int as pair, round(avg((li = lj)::int), 6) as agreement from w where rw <= 5 group by w", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    both = c.withColumn("pair", F.explode(F.array(F.col("batch") - 1, F.col("batch")))).filter("pair between 0 and 2")
    return S.label_agreement(both, 5, "label", ("pair",)).select("pair", F.round("agreement", 6).alias("agreement"))


@query("j8_knn_edges", sql("+" + near_sql() + " select i, j, round(d, 6) as d, r::int as rank from p where r <= 5", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    return K.knn(c, c, 5).select("i", "j", d6(), "rank")


@query("j8_descent_knn")
def _(spark, d):
    """The five nearest cells as neighbour descent finds them."""
    return D.approximate_knn(V.cells(spark, d), 5, width=30, leaf=128, change=0.02)


@query("j8_knn_cosine", sql("+" + near_sql(COSINE) + " select i, j, round(d, 6) as d, r::int as rank from p where r <= 5", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    return K.knn(c, c, 5, "cosine").select("i", "j", d6(), "rank")


@query("j6_within_batch_knn", sql("+" + near_sql(EUCLID, "a.cell_id <> b.cell_id and a.batch = b.batch") + " select i, j, round(d, 6) as d from p where r <= 5", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    return K.knn(c, c, 5, "euclidean", ("batch",)).select("i", "j", d6())


@query("j9_balanced_knn", sql("+" + near_sql(EUCLID, "a.cell_id <> b.cell_id", "i, bj") + " select i, j, round(d, 6) as d, bj as batch_j from p where r <= 3", "cells_v"))
def _(spark, d):
    return K.balanced_knn(V.cells(spark, d), 3).select("i", "j", d6(), "batch_j")


def _ab(spark, d, k: int):
    c = V.cells(spark, d)
    a, b = c.filter("batch = 0"), c.filter("batch = 1")
    return K.knn(a, b, k), K.knn(b, a, k)


@query("j16_mutual_nn", sql("+" + pairs_sql(EUCLID, "a.batch = 0 and b.batch = 1", "x", "i") + ", " + pairs_sql(EUCLID, "a.batch = 1 and b.batch = 0", "y", "i") + " select x.i as i, x.j as j, round(x.d, 6) as d from x join y on x.i = y.j and x.j = y.i where x.r <= 5 and y.r <= 5", "cells_v"))
def _(spark, d):
    return K.mutual(*_ab(spark, d, 5)).select("i", "j", d6())


@query("g4_symmetric_knn", sql("+" + near_sql() + ", u as (select i, j, d from p where r <= 5 union all select j, i, d from p where r <= 5) select i, j, round(max(d), 6) as d from u group by i, j", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    return K.symmetric(K.knn(c, c, 5)).select("i", "j", d6())


@query("w5_rank_weights", sql("+" + near_sql() + " select i, j, rank() over (partition by i order by d) + (count(*) over (partition by i, d) - 1) / 2 as weight from p where r <= 8", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    return G.rank_weights(K.knn(c, c, 8))


@query("m8_csls", sql("+" + near_sql() + ", s as (select i, avg(d) as r from p where r <= 10 group by i) select p.i as i, p.j as j, round(2 * d - a.r - b.r, 5) as d from p join s a on p.i = a.i join s b on p.j = b.i where p.r <= 10", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    near = K.knn(c, c, 10)
    s = K.local_scale(near)
    return K.hubness(near.select("i", "j", "d"), s, s, "csls").select("i", "j", F.round("d", 5).alias("d"))


@query("m9_gaussian_kernel", sql("+" + near_sql() + ", s as (select avg(m) as sigma from (select i, min(d) as m from p where r <= 5 group by i)) select i, j, round(exp(-d / sigma), 6) as weight from p, s where r <= 5", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    return G.gaussian(K.knn(c, c, 5)).select("i", "j", F.round("weight", 6).alias("weight"))


@query("k12_hub_penalised", sql("+" + near_sql() + ", n as (select * from p where r <= 10), g as (select j, count(*) as g from n group by j), t as (select i, n.j as j, row_number() over (partition by i order by g, d, n.j) as q from n join g using (j)) select i, j, q::int as rank from t where q <= 5", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    return K.hub_penalised(K.knn(c, c, 10), 5).select("i", "j", "rank")


@query("j14_local_scale", sql("+" + near_sql() + " select i, round(avg(d), 6) as r from p where r <= 2 group by i", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    return K.local_scale(K.knn(c, c, 2)).select("i", F.round("r", 6).alias("r"))


@query("j12_outlier_cut", sql("+" + pairs_sql(EUCLID, "a.batch = 0 and b.batch > 0", "x", "i, bj") + ", n as (select *, row_number() over (partition by bj order by d, i, j) as q, count(*) over (partition by bj) as n from x where r = 1), t as (select bj, max(case when q = floor(n * 0.75) + 1 then d end) as t from n group by bj) select bj as b, i, j, round(d, 6) as d from n join t using (bj) where d <= t", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    near = K.balanced_knn(c, 1).join(c.filter("batch = 0").select(F.col("cell_id").alias("i")), "i", "left_semi").filter("batch_j > 0")
    return M.outlier_cut(near.select(F.col("batch_j").alias("b"), "i", "j", "d"), 0.75, ("b",)).select("b", "i", "j", d6())


@query("j15_neighbour_copy", sql("+" + near_sql(EUCLID, "a.cell_id <> b.cell_id and a.batch = b.batch") + ", " + pairs_sql(EUCLID, "a.batch = 0 and b.batch = 1", "x", "i") + " select x.i as i, p.j as j, p.r::double as weight from x join p on x.j = p.i where x.r = 1 and p.r <= 4", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    intra = K.knn(c, c, 4, "euclidean", ("batch",)).select("i", "j", F.col("rank").cast("double").alias("weight"))
    m = K.knn(c.filter("batch = 0"), c.filter("batch = 1"), 1)
    return G.neighbour_copy(m, intra)


@query("u5_two_hop_minus_one_hop", sql("+" + near_sql() + ", e as (select i, j from p where r <= 3) select distinct x.i as i, y.j as j from e x join e y on x.j = y.i where x.i <> y.j and not exists (select 1 from e z where z.i = x.i and z.j = y.j)", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    return G.two_hops(K.knn(c, c, 3))


@query("g12_neighbour_lists", sql("+" + near_sql() + " select i, string_agg(j::varchar, ',' order by r) as neighbours from p where r <= 4 group by i", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    e = K.knn(c, c, 6).select("i", "j", F.col("d").alias("weight"))
    return G.neighbour_lists(e, 4).select("i", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query("g9_components", "with recursive e as materialized (select o_custkey as a, c_nationkey + 1000000 as b from orders join customer on o_custkey = c_custkey), u as materialized (select a, b from e union select b, a from e), r as (select a as node, a as c from u union select u.b, r.c from r join u on r.node = u.a) select node, min(c) as component from r group by node")
def _(spark, d):
    o, c = V.table(spark, d, "orders").select("o_custkey"), V.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    e = o.distinct().join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("i"), (F.col("c_nationkey") + 1_000_000).cast("long").alias("j"))
    return G.components(e)


@query("e3_silhouette", sql("+" + pairs_sql(EUCLID, "a.cell_id <> b.cell_id", "x", "i") + ", m as (select i, li, lj, avg(d) as m from x group by all), ab as (select i, max(case when li = lj then m end) as a, min(case when li <> lj then m end) as b from m group by i) select round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from ab", "cells_v"))
def _(spark, d):
    return S.silhouette(V.cells(spark, d)).select(F.round("silhouette", 6).alias("silhouette"))


KNI = """+su as (select cell_id, unnest(vec) as x, generate_subscripts(vec, 1) as dim from cells_v),
    sq as (select dim, avg(x) as m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as w from su group by dim),
    sv as (select cell_id, list((x - m) / case when w = 0 then 1 else w end order by dim) as vec from su join sq using (dim) group by cell_id),
    sc as materialized (select c.cell_id, c.batch, coalesce(c.label::varchar, 'Unknown') as label, sv.vec from cells_v c join sv using (cell_id)), """ + pairs_sql(EUCLID, "true", "x", "i").replace("cells_v", "sc") + """, t as (select * from x where r <= 10), s as (select i, any_value(bi) as batch, any_value(li) as label, sum((bi = bj)::int) as same from t group by i),
    v as (select i, lj, count(*) as n, row_number() over (partition by i order by count(*) desc, lj) as q from t group by i, lj), o as (select i, lj, row_number() over (partition by i order by count(*) desc, lj) as q from t where bi <> bj group by i, lj),
    k as (select s.*, v.lj as vote, o.lj as vote_other, same < 8.0 as diverse from s join v on s.i = v.i and v.q = 1 left join o on s.i = o.i and o.q = 1) """


@query("e5_kni_by_batch", sql(KNI + "select batch, round(avg((vote = label)::int), 6) as acc, round(avg(coalesce(diverse and vote_other = label, false)::int), 6) as kni, round(avg(diverse::int), 6) as diverse, round(avg(same), 6) as same from k group by batch", "cells_v"))
def _(spark, d):
    out = S.kni_by_batch(S.kni(V.cells(spark, d)))
    return out.select("batch", *[F.round(c, 6).alias(c) for c in ("acc", "kni", "diverse", "same")])


@query("e5_kni_confusion", sql(KNI + "select label as a, vote as b, count(*) as n from k group by all", "cells_v"))
def _(spark, d):
    return S.confusion(S.kni(V.cells(spark, d)), "label", "vote").select("a", "b", "n")


@query("p1_kni_status", sql(KNI + "select case when not diverse then 'low diversity' when vote_other = label then 'correct' else 'wrong' end as status, count(*) as n from k group by all", "cells_v"))
def _(spark, d):
    return S.kni_status(S.kni(V.cells(spark, d))).groupBy("status").agg(F.count("*").alias("n"))


@query("e6_ari", "with n as (select label as a, vec_id % 4 as b, count(*) as n from embeddings group by all), x as (select sum(n * (n - 1) / 2) as nij, sum(n) as t from n), a as (select sum(n * (n - 1) / 2) as na from (select sum(n) as n from n group by a)), b as (select sum(n * (n - 1) / 2) as nb from (select sum(n) as n from n group by b)) select round((nij - na * nb / (t * (t - 1) / 2)) / ((na + nb) / 2 - na * nb / (t * (t - 1) / 2)), 6) as ari from x, a, b")
def _(spark, d):
    return S.adjusted_rand(V.cells(spark, d), "label", "batch").select(F.round("ari", 6).alias("ari"))


@query("e11_nmi", "with n as (select label as a, vec_id % 4 as b, count(*) as n from embeddings group by all), x as (select *, sum(n) over () as t, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb from n) select round(2 * sum(n / t * ln(n * t / (na * nb))) / (-sum(n / t * ln(na / t)) - sum(n / t * ln(nb / t))), 6) as nmi from x")
def _(spark, d):
    return S.normalized_mutual_information(V.cells(spark, d), "label", "batch").select(F.round("nmi", 6).alias("nmi"))


@query("e8_knn_cv", sql("+f as materialized (select *, ((row_number() over (partition by label order by cell_id)) - 1) % 5 as fold from cells_v), x as materialized (select a.cell_id as i, b.cell_id as j, " + EUCLID.format(a="a.vec", b="b.vec") + " as d, a.fold as f, a.label as y, b.label as lj from f a join f b on a.fold <> b.fold), t as (select *, row_number() over (partition by i order by d, j) as r from x), v as (select i, f, y, lj, row_number() over (partition by i order by count(*) desc, lj) as q from t where r <= 5 group by i, f, y, lj), c as (select f, y, avg((lj = y)::int) as recall from v where q = 1 group by f, y), s as (select f, avg(recall) as s from c group by f) select round(avg(s), 6) as mean, round(stddev_pop(s), 6) as std from s", "cells_v"))
def _(spark, d):
    return S.knn_cross_validation(V.cells(spark, d)).select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("e8_leave_batch_out", sql("+x as materialized (select a.cell_id as i, b.cell_id as j, " + EUCLID.format(a="a.vec", b="b.vec") + " as d, a.batch as f, a.label as y, b.label as lj from cells_v a join cells_v b on a.batch <> b.batch), t as (select *, row_number() over (partition by i order by d, j) as r from x), v as (select i, f, y, lj, row_number() over (partition by i order by count(*) desc, lj) as q from t where r <= 5 group by i, f, y, lj), c as (select f, y, avg((lj = y)::int) as recall from v where q = 1 group by f, y), s as (select f, avg(recall) as s from c group by f) select round(avg(s), 6) as mean, round(stddev_pop(s), 6) as std from s", "cells_v"))
def _(spark, d):
    return S.knn_cross_validation(V.cells(spark, d), split="batch").select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("lt6_label_knn", sql("+" + pairs_sql(EUCLID, "a.batch = 1 and b.batch = 0", "x", "i") + ", v as (select i, lj, row_number() over (partition by i order by count(*) desc, lj) as q from x where r <= 5 group by i, lj) select i as cell_id, lj as label from v where q = 1", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    return T.label_knn(c.filter("batch = 1"), c.filter("batch = 0"))


@query("lt11_nearest_centre", sql("+c as (select label, list(m order by dim) as vec from (select label, dim, avg(x) as m from (select label, unnest(vec) as x, generate_subscripts(vec, 1) as dim from cells_v) group by all) group by label), x as (select cell_id, c.label as cluster, " + EUCLID.format(a="a.vec", b="c.vec") + " as d from cells_v a, c) select cell_id, cluster::bigint as cluster from (select *, row_number() over (partition by cell_id order by d, cluster) as r from x) where r = 1", "cells_v"))
def _(spark, d):
    c = V.cells(spark, d)
    return T.assign(c, T.centroids(c, "label").select(F.col("label").alias("cluster"), "vec")).select("cell_id", "cluster")


@query("e14_centroid_distances", sql("+c as (select label, list(m order by dim) as vec from (select label, dim, avg(x) as m from (select label, unnest(vec) as x, generate_subscripts(vec, 1) as dim from cells_v) group by all) group by label) select a.label as a, b.label as b, round(" + EUCLID.format(a="a.vec", b="b.vec") + ", 6) as d from c a join c b on a.label < b.label", "cells_v"))
def _(spark, d):
    c = T.centroids(V.cells(spark, d), "label").select("label", "vec")
    b = c.select(F.col("label").alias("b"), F.col("vec").alias("w"))
    return c.withColumnRenamed("label", "a").join(b, F.col("a") < F.col("b")).select("a", "b", F.round(euclidean(F.col("vec"), F.col("w")), 6).alias("d"))


@query("m13_rotate", "select vec_id as cell_id, round(mx + (x - mx) * 0 - (y - my) * 1, 6) as x, round(my + (x - mx) * 1 + (y - my) * 0, 6) as y from (select vec_id, embedding[1]::double as x, embedding[2]::double as y, avg(embedding[1]::double) over () as mx, avg(embedding[2]::double) over () as my from embeddings)")
def _(spark, d):
    out = rotated_all(V.cells(spark, d).select("cell_id", F.slice("vec", 1, 2).alias("v")), "v", 90)
    return out.select("cell_id", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"))


@query("j10_assignment")
def _(spark, d):
    c = V.cells(spark, d)
    return M.matched(c, M.stairs(c, (1,)))


@query("j10_auction")
def _(spark, d):
    """The same pairs by the auction, whatever their size: within a tenth of the least total distance."""
    c = V.cells(spark, d)
    return M.matched(c, M.stairs(c, (1,)), exact_up_to=0, slack=0.1)


@query("j17_align")
def _(spark, d):
    return M.aligned(V.cells(spark, d))


@query("g1_integrate")
def _(spark, d):
    return G.integrate(V.cells(spark, d))


@query("g2_linear_assignment_graph")
def _(spark, d):
    return G.linear_assignment_integrate(V.cells(spark, d))


@query("g5_spanning_trees")
def _(spark, d):
    return G.spanning_trees(V.cells(spark, d))


@query("g8_shortest_paths")
def _(spark, d):
    c = V.cells(spark, d)
    e = K.knn(c, c, 4).select("i", "j", F.col("d").alias("weight"))
    return G.shortest_paths(e, c.filter("cell_id % 50 = 0").select("cell_id"))


@query("lt1_diffuse")
def _(spark, d):
    c = V.cells(spark, d)
    e = G.gaussian(K.symmetric(K.knn(c, c, 8)))
    return G.spread_labels(e, c.select("cell_id", F.when(F.col("batch") < 2, F.col("label")).alias("label")))


@query("lt3_propagate")
def _(spark, d):
    c = V.cells(spark, d)
    e = G.gaussian(K.symmetric(K.knn(c, c, 8)))
    return G.spread_labels(e, c.select("cell_id", F.when(F.col("batch") < 2, F.col("label")).alias("label")), rounds=15, clamp=True)


@query("lt5_copy_labels")
def _(spark, d):
    return T.copy_labels(V.cells(spark, d), 0, 1)


@query("k11_near_mid_far")
def _(spark, d):
    return K.stratified_knn(V.cells(spark, d), 6)


@query("r1_combat")
def _(spark, d):
    return T.combat(V.cells(spark, d)).select("cell_id", "batch", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("r2_harmony")
def _(spark, d):
    out = T.harmony(V.cells(spark, d), clusters=6, rounds=3, cluster_rounds=3, blocks=3)
    return out.select("cell_id", "batch", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("r6_mnn_correct")
def _(spark, d):
    return T.mnn_correct(V.cells(spark, d), 0, 1)


@query("l1_pca")
def _(spark, d):
    return T.pca(V.cells(spark, d), 10)


@query("lt11_k_means")
def _(spark, d):
    c = V.cells(spark, d)
    return T.k_means(c, T.centroids(c, "label").select(F.col("label").cast("long").alias("cluster"), "vec"))


@query("e12_pareto_sample")
def _(spark, d):
    s = V.scores(spark, d).groupBy("method").agg(F.avg("label_mean").alias("label_mean"), F.stddev_samp("label_mean").alias("label_std"), F.avg("batch_mean").alias("batch_mean"), F.stddev_samp("batch_mean").alias("batch_std"))
    return S.pareto_sample(s)
