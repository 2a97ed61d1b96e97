"""Spanning trees and matches that are spread over tasks, against plain solvers."""

import numpy as np
import pytest
from test_units import points

from tessera.operators import auction as A
from tessera.operators import graph as G
from tessera.operators import knn as K
from tessera.operators import match as M


def prim(ids, x, metric):
    """Edges (lo, hi) and their total, ties by the two ids."""
    d = np.stack([K.exact(np.repeat(v[None], len(x), 0), x, metric) for v in x])
    inside, edges, total = {0}, set(), 0.0
    while len(inside) < len(ids):
        w, lo, hi, k = min((d[a, b], min(ids[a], ids[b]), max(ids[a], ids[b]), b) for a in inside for b in range(len(ids)) if b not in inside)
        inside.add(k)
        edges.add((lo, hi))
        total += w
    return edges, total


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_trees_by_rounds(spark, metric, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 40)
    rng = np.random.default_rng(1)
    far = np.repeat(np.eye(4) * 40, 25, 0) + rng.standard_normal((100, 4))  # four clusters: neighbours alone do not join them
    grid = np.stack([np.arange(36) % 6, np.arange(36) // 6], 1) @ np.eye(2, 4) + 1  # ties everywhere
    few, one = rng.standard_normal((5, 4)) + 9, rng.standard_normal((1, 4))
    rows, want = [], {}
    for b, x in enumerate((far, grid, few, one)):
        ids = [1000 * b + 7 * i % 101 for i in range(len(x))]
        rows += [(i, b, 0, v.tolist()) for i, v in zip(ids, x, strict=True)]
        want[b] = prim(ids, x, metric)
    got = G.spanning_trees(points(spark, rows), metric, k=5).toPandas()
    for b, (edges, total) in want.items():
        own = got[got.i // 1000 == b]
        assert {(min(e), max(e)) for e in zip(own.i, own.j, strict=True)} == edges and abs(own.d.sum() - total) < 1e-9
        above = dict(zip(own.j, own.i, strict=True))
        assert len(above) == len(edges)  # every cell but the root hangs below one other
        for j in above:
            while j in above:
                j = above[j]
            assert j == 1000 * b
    assert G.spanning_trees(points(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        G.spanning_trees(points(spark, rows), max_batch=50)


def two(spark, n, m, seed, shift=0.0, dims=5):
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((n, dims)), rng.standard_normal((m, dims)) + shift
    return x, y, points(spark, [*((i, 0, 0, v.tolist()) for i, v in enumerate(x)), *((1000 + i, 1, 0, v.tolist()) for i, v in enumerate(y))])


@pytest.mark.parametrize("n, m, hub, region", [(60, 60, "none", 40), (60, 100, "none", 4_000), (100, 50, "csls", 30), (70, 70, "local_scaling", None), (40, 55, "mutual_proximity", None)])
def test_auction_within_its_bound(spark, monkeypatch, n, m, hub, region):
    monkeypatch.setattr(K, "BLOCK", 50)
    monkeypatch.setattr(A, "BLOCK", 50)
    x, y, c = two(spark, n, m, n + m, 0.4)
    got = M.matched(c, M.stairs(c), hub=hub, exact_up_to=0, slack=0.2, region=region).toPandas()
    assert len(got) == min(n, m) and got.i.is_unique and got.j.is_unique and set(got["round"]) == {0}
    least = M.nearest_pairs(x, y, 1, "euclidean", hub)
    best = sum(p[2] for p in least)
    d = K.distances(x, y, "euclidean")
    if hub != "none":
        sa, sb = M.moments(x, y, "euclidean") if hub == "mutual_proximity" else M.local_scales(x, y, "euclidean", 12)
        d = A.reduced(d, hub, sa, sb)
    assert np.allclose(got.d, d[got.i, got.j - 1000], atol=1e-9)
    small = d if n <= m else d.T
    epsilon = 0.2 * np.abs(small.min(1)).mean()
    assert best - 1e-9 <= got.d.sum() <= best + min(n, m) * epsilon + 1e-9


def test_auction_closes_pairs_of_earlier_rounds(spark):
    x, y, c = two(spark, 30, 30, 3)
    got = M.matched(c, M.stairs(c), rounds=3, exact_up_to=0, slack=0.3).toPandas()
    assert len(got) == 90 and not got.duplicated(["i", "j"]).any()
    assert all(g.i.is_unique and g.j.is_unique and len(g) == 30 for _, g in got.groupby("round"))


def test_regions_cover_all_bidders(spark):
    _, _, c = two(spark, 300, 300, 5)
    a = A.Auction(c, M.stairs(c), "euclidean", 0.01, G.stored, region=40)
    got = a.regions().toPandas()
    assert sorted(got.i) == list(range(300)) and (got.regions.map(len) == A.TURNS).all()
    for t in range(A.TURNS):
        size = got.regions.map(lambda r, t=t: r[t]).value_counts()
        assert len(size) > 3 and size.max() <= 130


def test_bidding_stops_at_the_bound():
    lists = {1: ([10, 11], [1.0, 2.0], 2.5, None), 2: ([10, 11], [1.0, 5.0], 1.2, None), 3: ([10], [0.5], np.inf, None)}
    won, short = A.bidding(lists, {}, {}, 0.1)
    assert short == {1, 2} or (won[10][0] == 3 and set(won) <= {10, 11})
    assert A.bidding({1: ([], [], np.inf, None)}, {}, {}, 0.1) == ({}, {1})


def test_lists_are_made_where_the_vectors_are(spark, monkeypatch):
    """Lists of two objects run short at once: with the vectors at hand an epsilon takes one round, and none is asked for again."""
    _, _, c = two(spark, 60, 60, 9)
    asked = []
    whole = A.Auction.lists
    monkeypatch.setattr(A.Auction, "lists", lambda self, *how: asked.append(1) or whole(self, *how))
    a = A.Auction(c, M.stairs(c), "euclidean", 0.05, G.stored, listed=2)
    got = a.rounds(2).toPandas()
    assert len(asked) == 2  # one a round of matches
    assert len(got) == 120 and not got.duplicated(["i", "j"]).any()
    v = {r["cell_id"]: np.array(r["vec"]) for r in c.collect()}
    assert np.allclose(got.d, [np.linalg.norm(v[i] - v[j]) for i, j in zip(got.i, got.j, strict=True)])
    first = got[got["round"] == 0]
    left, right = (sorted(r["cell_id"] for r in c.filter(f"batch = {b}").collect()) for b in sorted(r["batch"] for r in c.select("batch").distinct().collect()))
    best = sum(p[2] for p in M.nearest_pairs(np.stack([v[i] for i in left]), np.stack([v[j] for j in right]), 1, "euclidean"))
    assert first.i.is_unique and first.j.is_unique and best - 1e-9 <= first.d.sum() <= 1.05 * best
