"""Small cases by brute force."""

import itertools

import numpy as np
import pytest

from tessera.operators import expr as X
from tessera.operators import graph as G
from tessera.operators import knn as K
from tessera.operators import match as M
from tessera.operators import score as S
from tessera.operators import transfer as T
from tessera.sources import tables as V
from tessera.streaming import slices as SL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(12))
def test_assignment(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 7, 2).tolist()
    cost = rng.integers(0, 9, (n, m)).astype(float)
    got = M.assignment(cost)
    small, large = (n, m) if n <= m else (m, n)
    c = cost if n <= m else cost.T
    want = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
    pairs = [(i, j) for i, j in enumerate(got.tolist()) if j >= 0]
    assert len(pairs) == small and len({j for _, j in pairs}) == small
    assert sum(cost[i, j] for i, j in pairs) == want


def points(spark, rows):
    return spark.createDataFrame(rows, "cell_id long, batch int, label int, vec array<double>")


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_knn_blocks(spark, monkeypatch, metric):
    monkeypatch.setattr(K, "BLOCK", 20)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((70, 3))
    c = points(spark, [(i, 0, 0, v.tolist()) for i, v in enumerate(x)])
    got = K.knn(c, c, 4, metric).toPandas().sort_values(["i", "rank"])
    d = K.exact(np.repeat(x, 70, 0), np.tile(x, (70, 1)), metric).reshape(70, 70)
    np.fill_diagonal(d, np.inf)
    assert got.j.tolist() == np.argsort(d, 1, kind="stable")[:, :4].ravel().tolist()


def test_unknown_metric(spark):
    with pytest.raises(Exception, match="unknown metric"):
        K.distances(np.ones((1, 2)), np.ones((1, 2)), "none")


def test_matching_limits(spark):
    c = points(spark, [(i, i % 2, 0, [float(i), 0.0]) for i in range(12)])
    assert M.matched(c, M.stairs(c)).count() == 6
    assert M.matched(c, M.stairs(c), rounds=2).groupBy("i", "j").count().filter("count > 1").count() == 0
    with pytest.raises(Exception, match="subsample first"):
        M.matched(c, M.stairs(c), max_batch=3).collect()


def test_components_and_paths(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 5.0), (1, 4, 3.5), (7, 8, 1.0)], "i long, j long, weight double")
    assert {tuple(r) for r in G.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7)}
    d = {r["node"]: r["d"] for r in G.shortest_paths(e, spark.createDataFrame([(1,)], "cell_id long")).collect()}
    assert d == {1: 0.0, 2: 1.0, 3: 2.0, 4: 3.5}
    chain = spark.range(40).selectExpr("id as i", "id + 1 as j")
    assert G.components(chain).select("component").distinct().count() == 1


def test_spanning_tree(spark):
    c = points(spark, [(0, 0, 0, [0.0]), (1, 0, 0, [1.0]), (2, 0, 0, [3.0]), (3, 0, 0, [7.0]), (9, 1, 0, [0.0])])
    assert sorted(r["d"] for r in G.spanning_trees(c).collect()) == [1.0, 2.0, 4.0]


def test_labels_spread(spark):
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in (0, 1, 4, 5)] + [(i + 1, i, 1.0) for i in (0, 1, 4, 5)], "i long, j long, weight double")
    y = spark.createDataFrame([(0, "a"), (1, None), (2, None), (4, "b"), (5, None), (6, None)], "cell_id long, label string")
    for clamp in (False, True):
        got = {r["cell_id"]: r["label"] for r in G.spread_labels(e, y, rounds=10, clamp=clamp).collect()}
        assert got == {0: "a", 1: "a", 2: "a", 4: "b", 5: "b", 6: "b"}


def test_rand_and_information(spark):
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 1)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert S.adjusted_rand(df, "a", "b").first()["ari"] == pytest.approx(0.324, abs=0.001)
    same = df.withColumn("b", df.a + 5)
    assert S.adjusted_rand(same, "a", "b").first()["ari"] == 1.0
    assert S.normalized_mutual_information(same, "a", "b").first()["nmi"] == pytest.approx(1.0)


def test_flow_pruning_covers_all(spark):
    pairs = spark.createDataFrame([("a", "x")] * 9 + [("a", "y"), ("b", "x"), ("c", "y")], "a string, b string")
    got = {tuple(r) for r in S.flow_prune(pairs, 0.5, 0, 0).collect()}
    assert got == {("a", "x", 9), ("b", "x", 1), ("c", "y", 1)}


def test_sampling(spark):
    c = points(spark, [(i, i % 3 if i < 20 else 0, 0, [0.0]) for i in range(40)])
    even = X.even_batches(c).groupBy("batch").count().collect()
    assert len({r["count"] for r in even}) == 1
    assert X.subsample(c, 7).count() == 7 and X.subsample(c, 100).count() == 40
    assert X.subsample(c, 3, ("batch",)).count() == 9
    assert sorted(X.subsample(c, 7).collect()) == sorted(X.subsample(c, 7).collect())


def test_hubness_kinds(spark):
    c = points(spark, [(i, 0, 0, [float(i * i), 1.0]) for i in range(12)])
    near = K.knn(c, c, 4)
    s = K.local_scale(near)
    for how in K.HUBNESS:
        assert K.hubness(near.select("i", "j", "d"), s, s, how).count() == near.count()


def test_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("gene\tc1\tc2\ng1\t0\t2\ng2\t3\t0\n")
    assert {tuple(r) for r in V.read_matrix(spark, str(tmp_path / "m.tsv")).collect()} == {("g1", "c2", 2.0), ("g2", "c1", 3.0)}
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n%x\n2 2 2\n1 2 5\n2 2 2\n")
    assert {tuple(r) for r in V.read_mtx(spark, str(tmp_path / "m.mtx")).collect()} == {(1, 2, 5.0), (2, 2, 2.0)}
    (tmp_path / "t.tsv").write_text("name\tx\ngroup\tnumeric\na\t1.5\n")
    assert V.read_typed_header(spark, str(tmp_path / "t.tsv")).collect() == [("a", 1.5)]
    s = V.scores(spark, SF)
    V.write_nested_json(s, str(tmp_path / "scores"))
    back = V.read_nested_json(spark, str(tmp_path / "scores"), "label_mean: double, batch_mean: double", "int")
    assert sorted(back.collect()) == sorted(s.collect())
    path = str(tmp_path / "cache")
    assert V.read_through(spark, path, lambda: spark.range(3)).count() == V.read_through(spark, path, lambda: spark.range(9)).count() == 3
    assert V.as_markdown(spark.range(1)).count("\n") == 2 and "tabular" in V.as_latex(spark.range(1))
    assert V.decode_plus_one(spark.createDataFrame([(1, 1.0), (2, 3.0)], "g int, value double")).collect() == [(2, 2.0)]
    assert V.blobs(spark, {(0, 0): 5, (1, 1): 7}).count() == 12


def test_missing_labels(spark):
    df = spark.createDataFrame([("a", "-1"), ("b", "x"), ("c", "Unassigned")], "s string, t string")
    assert [r["label"] for r in V.rename_obs(df, "s", "t").orderBy("batch").collect()] == [None, "x", None]


def test_correction_moves_towards_reference(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0, 0, rng.normal(0, 0.2, 2).tolist()) for i in range(40)] + [(100 + i, 1, 0, (rng.normal(0, 0.2, 2) + 1.0).tolist()) for i in range(40)]
    out = T.mnn_correct(points(spark, rows), 0, 1, 5).toPandas()
    assert np.abs(np.stack(out.vec).mean(0)).max() < 0.5


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    want = {tuple(r) for r in SL.slice_counts(events).collect()}
    events.coalesce(1).orderBy("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    SL.run_available(SL.slice_counts(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last = max(s for s, _, _ in want)
    assert got <= want and {r for r in want if r[0] < last} <= got


def test_hubness_between_batches():
    """A hub in the middle of one side loses its place to cells that are near in both sides' terms."""
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((20, 4)), rng.standard_normal((30, 4))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    rx, ry = np.sort(d, 1)[:, :6].mean(1), np.sort(d, 0)[:6].mean(0)
    want = {"csls": 2 * d - rx[:, None] - ry[None], "local_scaling": 1 - np.exp(-d * d / (rx[:, None] * ry[None]))}
    for how, cost in want.items():
        cols = M.assignment(cost)
        got = sorted(M.nearest_pairs(x, y, 1, "euclidean", how, 6))
        assert [(i, j) for i, j, _, _ in got] == list(enumerate(cols.tolist()))
        assert np.allclose([v for _, _, v, _ in got], cost[np.arange(20), cols])
    with pytest.raises(ValueError):
        M.nearest_pairs(x, y, 1, "euclidean", "rank")


def test_robust_scaling_and_missing_labels_in_kni(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 3)) * [1, 50, 0.1]
    rows = [(i, i % 2, None if i % 7 == 0 else i % 3, v.tolist()) for i, v in enumerate(x)]
    c = spark.createDataFrame(rows, "cell_id long, batch int, label int, vec array<double>")
    q = np.percentile(x, [25, 75], axis=0)
    z = (x - x.mean(0)) / (q[1] - q[0])
    got = {r["cell_id"]: r["vec"] for r in S.robust_scaled(c).collect()}
    assert np.allclose([got[i] for i in range(60)], z)
    labels = ["Unknown" if r[2] is None else str(r[2]) for r in rows]
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    for r in S.kni(c).collect():
        near = np.argsort(d[r["cell_id"]], kind="stable")[:10]
        assert r["same"] == sum(rows[j][1] == r["batch"] for j in near) and r["diverse"] == (r["same"] < 8)
        votes = [labels[j] for j in near]
        assert r["vote"] == min(set(votes), key=lambda v: (-votes.count(v), v)) and r["label"] == labels[r["cell_id"]]


def test_matrix_market_of_several_files(spark, tmp_path):
    for name, line in (("a", "1 1 5"), ("b", "2 1 7")):
        (tmp_path / f"{name}.mtx").write_text(f"%%MatrixMarket\n% note\n2 2 1\n{line}\n")
    assert sorted(tuple(r) for r in V.read_mtx(spark, str(tmp_path / "*.mtx")).collect()) == [(1, 1, 5.0), (2, 1, 7.0)]
    made = []
    for _ in range(2):
        V.read_through(spark, f"{tmp_path}/once", lambda: made.append(1) or spark.range(3)).count()
    assert made == [1]
