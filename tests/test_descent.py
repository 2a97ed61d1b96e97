"""Neighbour descent against the exact join: recall, comparisons, and rows that could get lost."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_units import points

from tessera.operators import descent as D
from tessera.operators import knn as K


def frame(spark, x, first=0):
    return points(spark, [(first + i, 0, 0, v.tolist()) for i, v in enumerate(x)])


def test_recall_and_comparisons(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 8)) @ rng.standard_normal((8, 32))  # eight dimensions, turned into 32
    c = D.stored(frame(spark, x))
    got, rounds = D.neighbour_graph(c, 5)
    got = D.stored(got)
    assert got.count() == 5 * 3000 and got.groupBy("i").agg(F.count_distinct("j").alias("n"), F.max("rank").alias("r")).filter("n <> 5 or r <> 5").count() == 0
    assert got.filter("i = j").count() == 0
    assert got.join(K.knn(c, c, 5).select("i", "j"), ["i", "j"]).count() >= 0.95 * 5 * 3000
    assert sum(r["compared"] for r in rounds) < 3000**2 / 10 and rounds[-1]["changed"] <= 0.01 * 3000 * 10
    p = got.toPandas()
    assert np.allclose(p.d, np.sqrt(((x[p.i] - x[p.j]) ** 2).sum(1)), atol=1e-9)
    assert (p.sort_values(["d", "j"]).groupby("i")["rank"].apply(list).map(lambda r: r == [1, 2, 3, 4, 5])).all()


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_one_leaf_is_exact(spark, metric):
    x = np.random.default_rng(2).integers(-3, 4, (60, 4)).astype(float)
    x = x[(x != 0).any(1)]  # with many ties
    c = frame(spark, x)
    order = lambda df: df.select("i", "j", F.round("d", 9), "rank").orderBy("i", "rank").collect()
    assert order(D.approximate_knn(c, 6, metric)) == order(K.knn(c, c, 6, metric))


def test_copies_of_a_third_and_cells_far_away(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 6))
    x[:300] = 7.0  # one vector, far more often than a leaf holds
    x[890:] = np.eye(10, 6) * 1e6 + rng.standard_normal((10, 6)) * 1e5
    got = D.approximate_knn(frame(spark, x), 4, leaf=16, width=6).toPandas()
    assert len(got) == 4 * 900 and not got.duplicated(["i", "j"]).any()
    same = got[got.i < 300]
    assert (same.d == 0).all() and (same.j < 300).all()


def test_rows_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (1, [9.0, 9.0]), (2, [2.0, 0.0]), (3, [4.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [0.0, 0.0]), (2**60 + 1, [8.0, 1.0])]
    c = spark.createDataFrame(rows, "cell_id long, vec array<double>").withColumns({n: F.lit("x") for n in ("i", "j", "d", "w", "u", "node", "home", "far", "slot")})
    got = {(r.i, r["rank"]): (r.j, r.d) for r in D.approximate_knn(c, 2).collect()}
    assert set(got) == {(i, r) for i in (1, 2, 3, 9, 2**60 + 1) for r in (1, 2)}
    assert got[1, 1] == (2, 1.0) and got[1, 2] == (9, 1.0) and got[3, 1] == (2, 2.0) and got[2**60 + 1, 1][0] == 3
    assert {r.i for r in D.approximate_knn(c, 2, "cosine").collect()} == {1, 2, 3, 2**60 + 1}
    assert D.approximate_knn(c.limit(0), 3).collect() == [] and D.approximate_knn(c.filter("cell_id = 3"), 3).collect() == []
    assert D.approximate_knn(c.filter("cell_id in (2, 3)"), 3).count() == 2


def test_pairs_of_blocks_and_nodes_give_the_same(spark, monkeypatch):
    """A vector goes once to each block of cells, not to every group of lists that leads to it; the graph does not depend on the blocks."""
    x = np.random.default_rng(4).standard_normal((700, 5))
    c, sent, joined = D.stored(frame(spark, x)), [], D._joined

    def counted(members, points, parts, width, metric):
        sent.append(parts)
        return joined(members, points, parts, width, metric)

    monkeypatch.setattr(D, "_joined", counted)
    found = []
    for blocks, rows, formed in ((1, 2048, 500_000), (3, 100, 500), (4, 100, 7)):
        monkeypatch.setattr(D, "BLOCKS", blocks)
        monkeypatch.setattr(D, "BLOCK", rows)
        monkeypatch.setattr(D, "FORMED", formed)
        got, rounds = D.neighbour_graph(c, 4, leaf=32)
        found.append((sorted(map(tuple, got.collect())), rounds))
    assert found[0] == found[1] == found[2]  # comparisons too: no pair is met in two tasks
    assert set(sent) == {1, 3, 4}
    assert len(found[0][0]) == 4 * 700 and got.join(K.knn(c, c, 4).select("i", "j"), ["i", "j"]).count() > 0.95 * 4 * 700
    monkeypatch.setattr(D, "ROWS_A_TASK", 90)  # several rounds of division
    assert D.approximate_knn(c, 4, leaf=32).join(K.knn(c, c, 4).select("i", "j"), ["i", "j"]).count() > 0.95 * 4 * 700
