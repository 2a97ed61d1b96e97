"""Files as users call them, samples, pruned links and agreement by batch on small tables."""

from test_units import points

from tessera.operators import expr as X
from tessera.operators import score as S
from tessera.sources import tables as V


def test_matrices_with_their_own_cells(spark, tmp_path):
    (tmp_path / "Liver_10x_SRS1_20.counts.tsv").write_text('gene\tc1\t"c2"\nA\t1\t0\n"B"\t0\t2.5\nC\tx\t4\n')
    (tmp_path / "Kidneyorganoids_7.counts.tsv").write_text("gene\tc2\tc9\tc8\nA\t3\t0\t5\n\n")
    (tmp_path / "empty.tsv").write_text("")
    (tmp_path / "none_1.tsv").write_text("gene\tc1\n")
    got = {tuple(r) for r in V.read_matrices(spark, [str(tmp_path)]).collect()}
    liver, kidney = ("Liver_10x_SRS1_20", "Liver", "Liver", "Liver_20"), ("Kidneyorganoids_7", "Kidneyorganoids", "Kidne", "Kidne_7")
    assert got == {("A", "c1", 1.0, *liver), ("B", "c2", 2.5, *liver), ("C", "c2", 4.0, *liver), ("A", "c2", 3.0, *kidney), ("A", "c8", 5.0, *kidney)}


def test_datasets_by_their_maps(spark, tmp_path):
    spark.createDataFrame([("t1", "a", 1), ("t1", "nan", 2), ("t1", None, 3), ("t2", "a", 4), ("t2", "b", 5), (None, "b", 6), (None, "c", 7)], "tech string, kind string, batch int").write.parquet(f"{tmp_path}/one.parquet")
    spark.createDataFrame([(1, "x")], "batch int, label string").write.parquet(f"{tmp_path}/two.parquet")
    maps = {"one": ("tech", "kind"), "two": ("batch", "label")}
    whole = V.read_datasets(spark, str(tmp_path), maps)
    assert list(whole) == ["one", "two"] and whole["one"].count() == 7
    assert [r.label for r in whole["one"].filter("batch = 't1'").orderBy("label").collect()] == [None, None, "a"]
    cut = V.read_datasets(spark, str(tmp_path), maps, ["one"], timeseries=True, drop_missing=True, min_cells=2)
    assert sorted((r.batch or "", r.label, r.timeseries) for r in cut["one"].collect()) == [("", "b", True), ("", "c", True), ("t2", "a", True), ("t2", "b", True)]


def test_samples(spark):
    rows = [(c, g, c % 3 if c < 28 else None, "bad" if c == 4 else None, 1.0) for c in range(30) for g in "ab"[: 1 + (c > 1)]]
    e = spark.createDataFrame(rows, "cell_id long, gene_id string, batch int, label string, value double")
    got = X.sampled_cells(e, 2, {"label": ["bad"]}, 3).toPandas()
    assert got.groupby(got.batch.fillna(-1)).cell_id.nunique().to_dict() == {-1: 2, 0: 3, 1: 3, 2: 3}
    assert not {0, 1, 4} & set(got.cell_id) and (got.groupby("cell_id").gene_id.nunique() == 2).all()
    assert X.sampled_cells(e).count() == len(rows) and X.sampled_cells(e.limit(0), 2, None, 3).count() == 0


def test_links_keep_one_for_every_node(spark):
    rows = [(0, p, "a") for p in range(20)] + [(0, 20, "z"), (0, 21, None), (0, 22, "a")]
    rows += [(1, p, "b" if p < 17 else "c" if p < 19 else "d") for p in range(22)]
    nodes, links = S.sankey(spark.createDataFrame(rows, "batch int, position long, label string"), 0.1)
    name = {r.node: f"{r.label}{r.batch}" for r in nodes.collect()}
    assert sorted(name) == list(range(len(name))) and [name[i] for i in sorted(name)] == sorted(name.values())
    assert {(name[r.source], name[r.target], r.value) for r in links.collect()} == {("a0", "b1", 17), ("a0", "c1", 2), ("z0", "d1", 1)}
    assert S.sankey(spark.createDataFrame([], "batch int, position long, label string"))[1].count() == 0


def test_rand_index_of_every_batch(spark):
    c = points(spark, [(i, i % 3 if i < 40 else None, i % 2 if i % 3 else 0, [0.0]) for i in range(50)] + [(99, 7, 1, [0.0])])
    c = c.selectExpr("cell_id", "batch", "label", "cell_id % 4 as other")
    got = {r.batch: r.ari for r in S.adjusted_rand_by(c, "label", "other").collect()}
    for b in (0, 1, 2):
        want = S.adjusted_rand(c.filter(f"batch = {b}"), "label", "other").first().ari
        assert abs(got[b] - want) < 1e-12
    assert abs(got[None] - S.adjusted_rand(c.filter("batch is null"), "label", "other").first().ari) < 1e-12 and got[7] == 1.0
