"""Jobs that used to stop at a size, or to leave rows out, done whole."""

import numpy as np
from pyspark.sql import functions as F
from test_units import SF, points

from tessera.operators import graph as G
from tessera.operators import knn as K
from tessera.operators import match as M
from tessera.operators import models as L
from tessera.plans import QUERIES
from tessera.sources import tables as V


def test_large_batches_have_matches_and_trees(spark):
    n = 4100  # beyond the 4,000 rows a batch of the former cap
    x = np.random.default_rng(3).standard_normal((n, 6))
    c = points(spark, [(2 * i + b, b, 0, (v + b * 1e-5).tolist()) for i, v in enumerate(x) for b in (0, 1)])
    got = M.matched(c, M.stairs(c)).toPandas()
    assert len(got) == n and (got.j == got.i + 1).all() and np.allclose(got.d, 6**0.5 * 1e-5, atol=1e-7)
    trees = G.spanning_trees(c).toPandas()
    assert len(trees) == 2 * (n - 1) and trees.groupby(trees.j % 2).j.nunique().tolist() == [n - 1, n - 1]


def test_matches_without_a_matrix(monkeypatch):
    rng = np.random.default_rng(4)
    for n, m in ((30, 40), (40, 30)):
        x, y = rng.standard_normal((n, 5)), rng.standard_normal((m, 5))
        want = M.nearest_pairs(x, y, 2, "euclidean")
        with monkeypatch.context() as k:
            k.setattr(M, "HELD", 0)
            got = M.nearest_pairs(x, y, 2, "euclidean")
        assert [p[:2] + p[3:] for p in got] == [p[:2] + p[3:] for p in want]
        assert np.allclose([p[2] for p in got], [p[2] for p in want])


def test_neighbours_among_many_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 8)) + 30
    same = rng.choice(1500, 400, replace=False)
    x[same] = x[same[0]]
    for metric in ("euclidean", "cosine"):
        c = points(spark, [(i, 0, 0, v.tolist()) for i, v in enumerate(x)])
        got = K.knn(c.filter(f"cell_id = {same[0]} or cell_id < 3"), c, 5, metric).toPandas().sort_values(["i", "rank"])
        for i, g in got.groupby("i"):
            d = K.exact(x[i][None], x, metric)
            d[i] = np.inf
            assert g.j.tolist() == np.argsort(d, kind="stable")[:5].tolist()


def test_paths_reach_all_batches(spark):
    kernel = QUERIES["g11_assignment_kernel"](spark, SF).toPandas()
    assert set(kernel.i) == set(range(0, 500, 50)) and len(kernel) == 10 * 500
    c = V.cells(spark, SF)
    groups = G.components(K.knn(c, c, 4).select("i", "j"))
    known = groups.join(c.filter("batch = 0"), groups.node == c.cell_id).select("component").distinct()
    want = {r["node"] for r in groups.join(known, "component").collect()}
    assert {r["cell_id"] for r in QUERIES["lt2_diffuse_on_paths"](spark, SF).collect()} == want


def test_all_labels_scored(spark, monkeypatch):
    import pyspark.ml.classification as C

    class Perfect:
        def __init__(self, **_):
            pass

        def fit(self, _):
            return self

        def transform(self, y):
            return y.withColumn("prediction", y.y)

    monkeypatch.setattr(C, "LinearSVC", Perfect)
    c = points(spark, [(i, 0, i, [0.0]) for i in range(103)])
    assert {r["label"] for r in L.linear_accuracy(c).collect()} == set(range(103))


def test_type_line_goes_by_its_place(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.tsv").write_text("x\ty\ngroup\tgroup\ngroup\tgroup\nz\tw\n")
    got = V.read_typed_header(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("group", "group")] * 2 + [("z", "w")] * 2


def test_reports_say_what_they_leave_out(spark):
    assert V.as_markdown(spark.range(7), 5).splitlines()[-1] == "| ... |" and "..." not in V.as_markdown(spark.range(5), 5)
    assert V.as_latex(spark.range(7), 5).count("...") == 1


def test_every_cell_has_four_non_neighbours(spark):
    out = QUERIES["k13_random_non_neighbours"](spark, SF).toPandas()
    assert (out.groupby("i").size() == 4).all() and out.i.nunique() == 500 and (out.i % 4 == out.j % 4).all()
    near = K.knn(V.cells(spark, SF), V.cells(spark, SF), 5).toPandas()
    assert not set(zip(near.i, near.j, strict=True)) & set(zip(out.i, out.j, strict=True))
