"""What larger tables brought up: values that are read twice, joins in larger blocks, matches of whole batches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import auction as A
from tessera.operators import knn as K
from tessera.operators import match as M
from tessera.operators import selectors as H


def test_gene_scores_use_one_evaluation(spark):
    """Sums that another evaluation would not give in the same bits: the gene in the middle of a bin still scores 0."""
    shaken = F.udf(lambda v: v * (1 + random.random() * 1e-9), "double").asNondeterministic()
    rng = np.random.default_rng(3)
    rows = [(i, f"g{g:02d}", 0, float(v)) for i, row in enumerate(rng.poisson(rng.uniform(1, 30, 25), (40, 25))) for g, v in enumerate(row) if v]
    e = spark.createDataFrame(rows, "cell_id long, gene_id string, batch int, value double").withColumn("value", shaken("value"))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # as where plans over large tables differ from branch to branch
    try:
        got = H.cell_ranger(e, e.select("batch", "cell_id"), 10, cuts=(25, 50, 75)).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert len(got) == 25 and sum(r.score == 0 for r in got) == 1


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("tile", [(512, 2048), (7, 5)])
def test_best_in_tiles(metric, tile, monkeypatch):
    """Every tiling gives the exact nearest, with ties, copies, null vectors, values that are not finite, and more asked than there are."""
    monkeypatch.setattr(K, "TILE", tile)
    monkeypatch.setattr(K, "HELD", 60)
    monkeypatch.setattr(K, "COMPARED", 11)
    rng = np.random.default_rng(5)
    far = rng.standard_normal((50, 6)) + 1e5
    y = np.concatenate([rng.integers(0, 3, (60, 6)).astype(float), far, far[:20], np.full((1, 6), np.nan), np.full((1, 6), np.inf), np.zeros((1, 6))])
    jds = rng.permutation(len(y)).astype(np.int64)
    x, ids = y[::3], jds[::3]
    marks = jds % 4
    for k in (1, 6, 40, 500):
        for self_too in (False, True):
            for closed in (None, (ids % 4, marks)):
                i, j, d = K.best(x, ids, y, jds, k, metric, self_too, closed)
                got = {}
                for a, b, c in zip(i.tolist(), j.tolist(), d.tolist(), strict=True):
                    got.setdefault(a, []).append((c, b))
                for v, a in zip(x, ids.tolist(), strict=True):
                    with np.errstate(all="ignore"):
                        e = K.exact(np.repeat(v[None], len(y), 0), y, metric)
                    want = sorted((c, b) for c, b in zip(e.tolist(), jds.tolist(), strict=True) if np.isfinite(c) and (self_too or a != b) and (closed is None or a % 4 != b % 4))[:k]
                    assert sorted(got.get(a, [])) == want


def test_blocks_do_not_grow_with_the_square():
    copies = [K.blocks(n) for n in (10, 4_096, 10_000, 100_000, 300_000, 600_000)]
    assert copies == [1, 1, 3, 6, 6, 10]


def test_auction_asks_few_times(spark, monkeypatch):
    """Lists of four are short for many bidders; the longer ones that follow hold all objects, over several blocks of objects."""
    from test_units import points

    monkeypatch.setattr(A, "LARGE", 70)
    asked, lists = [], A.Auction.lists
    monkeypatch.setattr(A.Auction, "lists", lambda self, *a: asked.append(a[-2:]) or lists(self, *a))
    rng = np.random.default_rng(8)
    c = points(spark, [(i, i % 2, 0, v.tolist()) for i, v in enumerate(rng.standard_normal((240, 12)))])
    monkeypatch.setattr(A.Auction.__init__, "__defaults__", (*A.Auction.__init__.__defaults__[:-1], 4))
    got = M.matched(c, M.stairs(c), exact_up_to=0).toPandas()
    want = M.matched(c, M.stairs(c), exact_up_to=None).toPandas()
    assert got.i.nunique() == got.j.nunique() == 120 and got.d.sum() <= 1.01 * want.d.sum() + 1e-9
    assert all(k == 120 for k, _ in asked[1:]) and sum(n for _, n in asked[1:]) <= 120  # nobody is asked a third time


def test_agreements_from_one_search(spark, monkeypatch):
    from tessera.operators import score as S
    from tessera.sources import tables as V

    searches, knn = [], K.knn
    monkeypatch.setattr(K, "knn", lambda *a, **b: searches.append(1) or knn(*a, **b))
    c = V.cells(spark, "/root/testdata/sf0.001")
    got = {r.k: r.score for r in S.label_agreements(c, (3, 9)).collect()}
    assert len(searches) == 1
    assert got == {k: pytest.approx(S.label_agreement(c, k).first()[0], abs=1e-12) for k in (3, 9)}


def test_a_table_with_itself_is_sent_once_a_block(spark, monkeypatch):
    """Both ways of a pair of blocks in one task: the same pairs as from two tables, and one exchange of vectors."""
    monkeypatch.setattr(K, "BLOCK", 20)
    rng = np.random.default_rng(8)
    rows = [(i, i % 3 if i % 3 else None, v.tolist()) for i, v in enumerate(rng.integers(0, 4, (150, 3)).astype(float))]
    c = spark.createDataFrame(rows, "cell_id long, batch int, vec array<double>")
    for by in ((), ("batch",)):
        for self_too in (False, True):
            one, two = K.knn(c, c, 4, "euclidean", by, self_too), K.knn(c, c.select("*"), 4, "euclidean", by, self_too)
            assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
            dealt = lambda df: "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()
            assert (dealt(one), dealt(two)) == (False, True)
    none = c.limit(0)
    assert K.knn(none, none, 4).count() == 0


def test_goods_of_equal_vectors_are_bid_for_together(monkeypatch):
    """Twelve copies of every vector on both sides: few bids, no copy's price climbs by epsilons past the others, and all are matched."""
    rng = np.random.default_rng(2)
    x, y = (np.repeat(rng.standard_normal((40, 3)), 12, 0) for _ in range(2))
    stock, one = A.Goods(y[::12], np.ones(40), "euclidean", "none"), np.ones(len(x))
    asked = []
    fetch = lambda who, price, k: asked.append(len(who)) or stock.cheapest(x[who], one[who], k, price)
    cols, costs, bound = stock.cheapest(x, one, 8)
    epsilons = A.steps(costs, 0.01, True, 1.0)
    held = A.sold(cols, costs, bound, np.arange(41) * 12, epsilons, fetch)
    assert sorted(held) == list(range(480))
    d = K.distances(x, y, "euclidean")
    best = sum(p[2] for p in M.least_pairs(480, 480, lambda i: d[i]))
    assert best - 1e-6 <= d[np.arange(480), held].sum() <= best + 480 * epsilons[-1] + 1e-6


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("hub", ["none", "csls", "local_scaling", "mutual_proximity"])
def test_cheapest_goods_in_tiles(metric, hub, monkeypatch):
    monkeypatch.setattr(A, "TILE", (16, 700))
    rng = np.random.default_rng(3)
    for m in (3000, 90, 7):
        x, y = rng.standard_normal((60, 5)), rng.standard_normal((m, 5))
        scale = lambda n: rng.uniform(0.5, 1, (n, 2) if hub == "mutual_proximity" else n)
        sx, sy, price = scale(60), scale(m), rng.uniform(0, 0.2, m)
        shut = [[1, 5] if i % 3 == 0 else None for i in range(60)]
        cols, costs, bound = A.Goods(y, sy, metric, hub).cheapest(x, sx, 12, price, shut)
        net = A.reduced(K.distances(x, y, metric), hub, sx, sy)
        net[::3, [1, 5]] = np.inf
        net += price
        order = np.sort(net, 1)
        for i in range(60):
            own = np.isfinite(costs[i])
            assert np.allclose(np.sort(costs[i][own] + price[cols[i][own]]), order[i][np.isfinite(order[i])][:12], atol=1e-6)
            rest = np.delete(net[i], cols[i][own])
            assert not len(rest) or bound[i] <= rest.min() + 1e-9


def test_scores_share_a_search(spark, monkeypatch):
    """One search for both agreements, and one for both cross validations; short lists are asked again, with the same result."""
    from tessera.operators import score as S
    from tessera.sources import tables as V

    c = V.cells(spark, "/root/testdata/sf0.001")
    want = [S.label_agreement(c, 5, on).first()[0] for on in ("label", "batch")]
    plain = S.knn_cross_validation(c, "batch", invert=True).first()
    searches, knn = [], K.knn
    monkeypatch.setattr(K, "knn", lambda *a, **b: searches.append(1) or knn(*a, **b))
    got = S.agreements_on(c, ("label", "batch")).first()
    assert len(searches) == 1 and list(got) == pytest.approx(want, abs=1e-12)
    for k, more in ((16, 0), (6, 1)):
        near = S.stored(knn(c, c, k).select("i", "j", "d"))
        searches.clear()
        got = S.knn_cross_validation(c, "batch", invert=True, among=near).first()
        assert len(searches) == more and list(got) == pytest.approx(list(plain), abs=1e-12)
