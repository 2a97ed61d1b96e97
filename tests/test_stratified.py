"""Near, middle and far neighbours without lists of half of all cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn as K


def test_pair_hash_is_the_column_function(spark):
    ids = [0, 1, -5, 2**40 + 3, 7]
    df = spark.createDataFrame([(i, j) for i in ids for j in ids], "i long, j long")
    want = {(r["i"], r["j"]): r["h"] for r in df.select("i", "j", F.xxhash64("i", "j", F.lit(3)).alias("h")).collect()}
    got = K.pair_hash(np.array(ids), np.array(ids), 3)
    assert {(i, j): int(got[a, b]) for a, i in enumerate(ids) for b, j in enumerate(ids)} == want


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_same_pairs_as_from_the_lists(spark, metric, monkeypatch):
    """With copies, ties, values that are not finite, several blocks and so few drawn that cells ask again."""
    monkeypatch.setattr(K, "BLOCK", 40)
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.standard_normal((60, 5)), rng.integers(-1, 2, (40, 5)) + 0.5])
    v = np.concatenate([v, v[40:80], np.full((1, 5), np.nan)])
    c = spark.createDataFrame([(i * 3, row.tolist()) for i, row in enumerate(v)], "cell_id long, vec array<double>")
    n = len(v)
    want = K.stratified(K.knn(c, c, n // 2, metric), 4, n).collect()
    got = K.stratified_knn(c, 4, metric, drawn=30).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 13 * 100
