"""Shortest paths by blocks of nodes, labels spread in columns."""

import heapq

import numpy as np
import pytest

from tessera.operators import graph as G


def _links(n: int, seed: int):
    rng = np.random.default_rng(seed)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, n, 2 * n), rng.integers(0, n, 2 * n), rng.integers(0, 9, 2 * n) / 8)]
    return [*rows, (n + 10, n + 11, 2.0)]


def _dijkstra(rows, source: int, most: float) -> dict:
    near: dict = {}
    for i, j, w in rows:
        near.setdefault(i, []).append((j, w))
        near.setdefault(j, []).append((i, w))
    done, heap = {}, [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in done:
            done[v] = d
            for u, w in near.get(v, ()):
                if d + w <= most:
                    heapq.heappush(heap, (d + w, u))
    return done


@pytest.mark.parametrize("most", [None, 0.75])
@pytest.mark.parametrize("tasks", [(64, 1 << 18), (3, 9)])
def test_paths_across_blocks(spark, most, tasks):
    """One block and several give what Dijkstra does, with copies of edges, loops, weights of 0 and a source without edges."""
    rows, asked = _links(40, 4), [0, 3, 7, 21, 39, 50, 999]
    e = spark.createDataFrame(rows, "i long, j long, weight double")
    got = G.shortest_paths(e, spark.createDataFrame([(i,) for i in asked], "cell_id long"), most, *tasks).collect()
    want = {(s, v): d for s in asked for v, d in _dijkstra(rows, s, most if most is not None else np.inf).items()}
    assert {(r["source"], r["node"]): r["d"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("clamp", [False, True])
def test_labels_in_columns(spark, clamp, monkeypatch):
    """Labels in tables of two columns give what a matrix does."""
    monkeypatch.setattr(G, "LABELS", 2)
    rows = {(min(i, j), max(i, j)): w + 0.5 for i, j, w in _links(30, 6) if i != j}
    both = [(i, j, w) for (i, j), w in rows.items()] + [(j, i, w) for (i, j), w in rows.items()]
    names = sorted({i for i, _, _ in both})
    label = {i: "abcde"[n % 5] for n, i in enumerate(names) if n % 3}
    y = spark.createDataFrame([(i, label.get(i)) for i in names], "cell_id long, label string")
    got = G.spread_labels(spark.createDataFrame(both, "i long, j long, weight double"), y, 0.3, 6, clamp).collect()
    w = np.zeros((len(names), len(names)))
    for i, j, x in both:
        w[names.index(i), names.index(j)] = x
    g = w.sum(1)
    s = w / (g[:, None] if clamp else np.sqrt(g[:, None] * g[None]))
    start = np.array([[float(label.get(i) == x) for x in "abcde"] for i in names])
    f, held = start, start.any(1)
    for _ in range(6):
        f = np.where(held[:, None], start, s @ f) if clamp else 0.3 * s @ f + 0.7 * start
    want = {i: (f[n].max(), "abcde"[f[n].argmax()]) for n, i in enumerate(names) if f[n].max() > 0}
    assert {r["cell_id"] for r in got} == set(want)
    for r in got:
        assert r["score"] == pytest.approx(want[r["cell_id"]][0]) and r["label"] == want[r["cell_id"]][1]
