"""Batch correction, gene selectors and paired mixtures against plain numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_units import points

from tessera.operators import correct as C
from tessera.operators import models as L
from tessera.operators import selectors as H
from tessera.operators import transfer as T


def cloud(seed, n, shifts, dims=4):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((3, dims)) * 3
    rows = []
    for b, s in enumerate(shifts):
        for _ in range(n):
            rows.append((len(rows), b, 0, (middle[rng.integers(3)] + rng.standard_normal(dims) * 0.4 + s).tolist()))
    return rows


def plain_harmony(z0, batch, block, first, theta, sigma, ridge, rounds, cluster_rounds):
    n_batches, blocks = batch.max() + 1, block.max() + 1
    share = np.bincount(batch) / len(batch)
    phi = np.eye(n_batches)[batch].T
    z, y, trace = z0.copy(), C.unit(first), []
    r = np.zeros((len(y), len(z)))

    def soft(cols, penalty):
        d = 2 * (1 - y @ C.unit(z[cols]).T)
        out = np.exp(-d / sigma) * (penalty @ phi[:, cols])
        return out / out.sum(0)

    penalty = [np.ones((len(y), n_batches))] * blocks
    centres = [y] * blocks
    for _ in range(rounds):
        for k in range(blocks):
            y = centres[k]
            r[:, block == k] = soft(block == k, penalty[k])
        for _ in range(cluster_rounds):
            new = C.unit(r @ C.unit(z))
            for k in range(blocks):
                y = centres[k] = new
                seen = r[:, block != k] @ phi[:, block != k].T
                penalty[k] = ((seen.sum(1, keepdims=True) * share + 1) / (seen + 1)) ** theta
                r[:, block == k] = soft(block == k, penalty[k])
            d = 2 * (1 - new @ C.unit(z).T)
            seen = r @ phi.T
            trace.append((r * d).sum() + sigma * (r * np.log(r)).sum() + sigma * theta * (seen * np.log((seen + 1) / (seen.sum(1, keepdims=True) * share + 1))).sum())
        out = z0.copy()
        design = np.vstack([np.ones(len(z)), phi])
        for k in range(len(r)):
            w = np.linalg.solve((design * r[k]) @ design.T + np.diag([0] + [ridge] * n_batches), (design * r[k]) @ z0)
            w[0] = 0
            out -= (design * r[k]).T @ w
        z = out
    return z, trace


def test_harmony_against_numpy(spark):
    rows = cloud(1, 70, [0, 2.5])
    c = points(spark, rows).repartition(3)
    h = C.Harmony(c, clusters=5, blocks=3)
    data = h.data.orderBy("cell_id").toPandas()
    got = h.run(rounds=2, cluster_rounds=3, tolerance=0, cluster_tolerance=-np.inf).orderBy("cell_id").toPandas()
    drawn = h.data.orderBy(F.xxhash64("cell_id"), "cell_id").limit(5).select("origin").toPandas()
    want, trace = plain_harmony(np.stack(data.origin), data.b.to_numpy(), data.block.to_numpy(), np.stack(drawn.origin), 2.0, 0.1, 1.0, 2, 3)
    assert np.allclose(np.stack(got.vec), want, atol=1e-8) and np.allclose(h.trace, trace, atol=1e-8)
    assert h.trace[2] < h.trace[1] < h.trace[0] and h.trace[-1] < h.trace[0]  # smoothed counts: near the end a round may rise a little
    far = lambda v: np.linalg.norm(v[:70].mean(0) - v[70:].mean(0))
    assert far(np.stack(got.vec)) < 0.4 * far(np.stack(data.origin))
    assert C.harmony(c.limit(0)).collect() == []
    assert C.harmony(c.filter("batch = 0"), clusters=2, rounds=1).count() == 70


def test_scanorama_joins_by_score(spark):
    rng = np.random.default_rng(4)
    types = np.array([[4, 1, 0, 0], [0, 4, 1, 0], [0, 0, 4, 1], [-4, 0, 0, 3.0]])
    rows = []
    for b, (kinds, shift) in enumerate([((0, 1), 0.0), ((0, 1, 2), 0.8), ((3,), -0.5), ((0, 1, 2), 0.4)]):
        rows += [(0, b, k, (types[k] + rng.standard_normal(4) * 0.15 + shift).tolist()) for k in kinds for _ in range(20 + b)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    c = points(spark, rows)
    out = C.scanorama(c, k=5).orderBy("cell_id").toPandas()
    again = C.scanorama(c.withColumn("batch", 3 - F.col("batch")), k=5).orderBy("cell_id").toPandas()
    assert out.columns.tolist() == c.columns and np.allclose(np.stack(out.vec), np.stack(again.vec))  # no batch is a reference
    before = C.unit(np.stack([r[3] for r in rows]))
    spread = lambda v: max(np.linalg.norm(a - b) for k in (0, 1) for a, b in [(v[(out.batch == 0) & (out.label == k)].mean(0), v[(out.batch == 1) & (out.label == k)].mean(0))])
    now = np.stack(out.vec)
    assert spread(now) < 0.7 * spread(before)
    apart = C.scanorama(c, k=5, least=1.1).orderBy("cell_id").toPandas()
    assert np.allclose(np.stack(apart.vec), before)  # nothing matches so well


def test_scanorama_moves_by_the_kernel(spark):
    c = points(spark, [(i, 0, 0, v) for i, v in enumerate(np.random.default_rng(2).standard_normal((30, 3)).tolist())])
    rng = np.random.default_rng(3)
    at, move = rng.standard_normal((11, 3)), rng.standard_normal((11, 3))
    bias = spark.createDataFrame([(i, a, m) for i, (a, m) in enumerate(zip(at.tolist(), move.tolist(), strict=True))], "id long, at array<double>, move array<double>")
    x = np.array([r["vec"] for r in c.orderBy("cell_id").collect()])
    w = np.exp(-0.7 * ((x[:, None] - at[None]) ** 2).sum(2))
    got = np.array([r["vec"] for r in C._moved(c, bias, 0.7).orderBy("cell_id").collect()])
    assert np.allclose(got, x + w @ move / w.sum(1, keepdims=True))


def test_linked_sums_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "SUMMED", 9)
    monkeypatch.setattr(C.K, "COMPARED", 7)
    rng = np.random.default_rng(6)
    v = rng.standard_normal((40, 3))
    links = [(i, int(j), float(rng.random())) for i in range(0, 60, 2) for j in rng.choice(40, rng.integers(1, 9), replace=False)]
    got = C.linked_sums(spark.createDataFrame(links, "i long, j long, w double"), points(spark, [(i, 0, 0, x.tolist()) for i, x in enumerate(v)])).collect()
    assert len(got) == 30
    for r in got:
        own = [(j, w) for i, j, w in links if i == r["i"]]
        assert np.isclose(r["w"], sum(w for _, w in own)) and np.allclose(r["m"], sum(w * v[j] for j, w in own))


def test_scanorama_has_one_bias_a_cell(spark, monkeypatch):
    """Cells with many matches count with all of them, but their place is sent once."""
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, 0, (rng.standard_normal(3) + 3 + i % 2).tolist()) for i in range(60)]
    seen, step = [], C._moved
    monkeypatch.setattr(C, "_moved", lambda cells, bias, gamma: (seen.append((cells.count(), bias.count())), step(cells, bias, gamma))[1])
    out = np.stack(C.scanorama(points(spark, rows), k=6).orderBy("cell_id").toPandas().vec)
    assert seen and all(b <= c for c, b in seen)
    x = C.unit(np.stack([r[3] for r in rows]))
    a, b = x[::2], x[1::2]
    d = ((a[:, None] - b[None]) ** 2).sum(2)
    i, j = np.nonzero((d.argsort(1).argsort(1) < 6) & (d.argsort(0).argsort(0) < 6))
    assert len(i) > 30
    w = np.exp(-7.5 * ((a[:, None] - a[i][None]) ** 2).sum(2))
    x[::2] += w @ (b[j] - a[i]) / w.sum(1, keepdims=True)  # of equal groups the first moves
    assert np.allclose(out, x)


def test_mnn_correct_against_numpy(spark):
    rng = np.random.default_rng(9)
    rows = [(i, i % 3, 0, (rng.standard_normal(3) + i % 3).tolist()) for i in range(120)]
    out = T.mnn_correct(points(spark, rows), 0, 1, 6)
    assert "posexplode" not in out._jdf.queryExecution().toString()  # no row a link and dimension
    got = np.array([r["vec"] for r in out.orderBy("cell_id").collect()])
    u, v = (np.array([r[3] for r in rows if r[1] == b]) for b in (0, 1))
    d = np.sqrt(((v[:, None] - u[None]) ** 2).sum(2))
    both = (d.argsort(1).argsort(1) < 6) & (d.argsort(0).argsort(0) < 6)
    at = np.flatnonzero(both.any(1))
    assert 6 < len(at) < len(v)
    shift = np.array([u[both[i]].mean(0) - v[i] for i in at])
    near = np.sqrt(((v[:, None] - v[at][None]) ** 2).sum(2))
    for i, x in enumerate(v):
        j = near[i].argsort()[:6]
        w = np.exp(-near[i, j] ** 2 / (2 * (near[i, j].mean() + 1e-9) ** 2))
        assert np.allclose(got[i], x + w @ shift[j] / w.sum())


def test_merge_order():
    sizes = {"a": 10, "b": 30, "c": 25, "d": 1}
    got = C.merge_order([("a", "b", 0.9), ("b", "c", 0.5), ("a", "c", 0.6), ("c", "d", 0.05)], sizes, 0.1)
    assert got == [(("a",), ("b",)), (("c",), ("a", "b"))]


def test_local_quadratic_against_polyfit():
    rng = np.random.default_rng(5)
    x = np.sort(rng.standard_normal(60))
    y = np.sin(x) + rng.standard_normal(60) * 0.1
    got = H.local_quadratic(x, y, x, 0.3)
    for i, at in enumerate(x):
        d = np.abs(x - at)
        h = np.sort(d)[17]
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        assert abs(np.polyval(np.polyfit(x - at, y, 2, w=np.sqrt(w)), 0) - got[i]) < 1e-8
    assert np.allclose(H.local_quadratic(np.ones(5), np.arange(5.0), np.ones(1)), 2)


@pytest.mark.parametrize("seed", range(4))
def test_huber_line_is_the_minimum(seed):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.random(14) * 4)
    y = 1 + 0.3 * x + rng.standard_normal(14) * 0.1
    y[rng.integers(14)] += 4

    def loss(slope, start, s):
        z = np.abs(y - slope * x - start) / s
        return len(y) * s + s * np.where(z <= 1.35, z * z, 2.7 * z - 1.35**2).sum() + 1e-4 * slope**2

    slope, start = H.huber_line(x, y)
    scale = min(np.linspace(0.01, 1, 20_000), key=lambda s: loss(slope, start, s))
    least = loss(slope, start, scale)
    assert min(loss(slope + a, start + b, scale) for a in (-1e-2, 0, 1e-2) for b in (-1e-2, 0, 1e-2)) >= least - 1e-9
    assert abs(slope - 0.3) < 0.15


def test_dispersion_residuals_against_plain(spark):
    rng = np.random.default_rng(6)
    mean = np.concatenate([np.exp(rng.random(200) * 3.5) - 0.9, [0.001, 500.0, 2.0]])
    disp = np.concatenate([np.exp(rng.standard_normal(200) * 0.3) * mean[:200] ** 0.4, [1.0, 1.0, np.nan]])
    rows = [(0, f"g{i}", float(m), None if np.isnan(v) else float(v)) for i, (m, v) in enumerate(zip(mean, disp, strict=True))]
    got = {r["gene_id"]: r["score"] for r in H.dispersion_residuals(spark.createDataFrame(rows, "batch int, gene_id string, mean double, dispersion double")).collect()}
    x, y = np.log1p(mean), np.log(disp)
    inside = (x > 0.015) & (x < 4) & ~np.isnan(y)
    edges = np.arange(0.25, 4, 0.25)
    boxes = [(e, y[inside & (x > e) & (x < e + 0.25)]) for e in edges]
    boxes = [(e + 0.125, np.median(b), b.std()) for e, b in boxes if len(b)]
    c, m, s = map(np.array, zip(*boxes, strict=True))
    want = np.zeros(len(x))
    value = lambda v: np.where(x < c[0], max(v[0], np.polyval(H.huber_line(c, v), c[0])), np.polyval(H.huber_line(c, v), x))
    want[inside] = ((y - value(m)) / value(s))[inside]
    assert np.allclose([got[f"g{i}"] for i in range(len(x))], want, atol=1e-9)


def plain_mixture(views, y, clusters):
    for _ in range(100):
        total = 0
        each = []
        for x in views:
            like = np.empty((len(x), clusters))
            for k in range(clusters):
                own = x[y == k]
                n = len(own) + 10 * np.finfo(float).eps
                mean = own.sum(0) / n
                cov = (own - mean).T @ (own - mean) / n + 1e-6 * np.eye(x.shape[1])
                d = x - mean
                like[:, k] = -0.5 * (x.shape[1] * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + (d @ np.linalg.inv(cov) * d).sum(1))
            total = total + like
            each.append(like.argmax(1))
        new = total.argmax(1)
        if (new == y).all():
            return new, (np.stack(each) != each[0]).any(0)
        y = new


def test_paired_mixture_against_numpy(spark):
    rng = np.random.default_rng(7)
    kind = rng.integers(3, size=150)
    views = [np.stack([rng.standard_normal(2)[k % 2] * 0 + np.array([3.0 * k, k * k, 0])[:d] + rng.standard_normal(d) @ np.diag([1, 0.5, 0.7][:d]) for k in kind]) for d in (3, 2)]
    start = np.where(rng.random(150) < 0.25, rng.integers(3, size=150), kind)
    frames = [spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>").repartition(3) for x in views]
    first = spark.createDataFrame([(i, "abc"[k]) for i, k in enumerate(start.tolist())] + [(999, None)], "cell_id long, cluster string")
    got = L.paired_mixture(frames, first).orderBy("cell_id").toPandas()
    want, differ = plain_mixture(views, start, 3)
    assert got.cluster.tolist() == ["abc"[k] for k in want] and got.disagree.tolist() == differ.tolist() and differ.any()
    with pytest.raises(RuntimeError):
        L.paired_mixture(frames, first, rounds=0)
    assert L.paired_mixture([f.limit(0) for f in frames], first).collect() == []


def test_linear_scores_against_numpy(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(3)) if k else 1, k, (rng.standard_normal(3) + k).tolist()) for i in range(120) for k in [int(rng.integers(3))]]
    c = points(spark, rows).repartition(3)
    got = {(r["g"], r["truth"], r["guess"]): r["n"] for r in L.linear_confusion(c, "label").collect()}
    x = np.column_stack([np.array([r[3] for r in rows]), np.ones(len(rows))])
    fit = lambda x, y: np.linalg.solve(x.T @ x + 1e-3 * np.eye(4), x.T @ (2 * np.eye(y.max() + 1)[y] - 1))
    y = np.array([r[2] for r in rows])
    guess = (x @ fit(x, y)).argmax(1)
    assert got == {(None, str(a), str(b)): int(((y == a) & (guess == b)).sum()) for a in range(3) for b in range(3) if ((y == a) & (guess == b)).any()}
    assert abs(L.linear_label_score(c).first()["score"] - (y == guess).mean()) < 1e-12
    batch, scores = np.array([r[1] for r in rows]), []
    for k in (1, 2):
        own, b = x[y == k], batch[y == k]
        g = (own @ fit(own, b)).argmax(1)
        scores.append(1 - (np.mean([(g[b == v] == v).mean() for v in range(3)]) - 1 / 3) / (2 / 3))
    assert abs(L.linear_batch_score(c).first()["score"] - np.mean(scores)) < 1e-12
    assert L.linear_confusion(c.limit(0), "label").collect() == []


def test_halving_finds_the_best_of_the_grid(spark):
    from tessera.operators import score as S

    rng = np.random.default_rng(11)
    c = points(spark, [(i, 0, k, (rng.standard_normal(3) * 0.8 + 2 * np.eye(3)[k]).tolist()) for i in range(400) for k in [int(rng.integers(3))]])
    grid = spark.createDataFrame([(f"k{k}", k, "euclidean") for k in (1, 2, 5, 12, 40, 90)], "point string, k int, metric string")
    out = S.successive_halving(c, grid, S.agreement_grid).toPandas()
    full = S.agreement_grid(c, grid).toPandas().set_index("point").score
    assert out.groupby("round").size().tolist() == [6, 2, 1] and sorted(out[out["round"] == 2].cells) == [400]
    assert out[out["round"] == 2].point.tolist() == [full.idxmax()]
    for r in full.items():
        plain = S.label_agreement(c, int(r[0][1:])).first()["agreement"]
        assert abs(plain - r[1]) < 1e-12


def test_paired_mixture_goes_on_until_no_cell_moves(spark):
    """More than a hundred rounds pass before the last cell has moved."""
    rng = np.random.default_rng(1)
    n, clusters = 6000, 5
    x, y = np.sort(rng.standard_normal((n, 1)), 0) * 3, np.minimum(np.arange(n) * clusters * 3 // n, clusters - 1)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    start = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)], "cell_id long, cluster int")
    got = L.paired_mixture([frame], start).orderBy("cell_id").toPandas()
    rounds, last = 0, None
    while last is None or (last != y).any():
        models = L._view_models(L._view_sums([x], y, clusters), 1e-6)
        last, y, rounds = y, L._view_likelihoods([x], models)[0].argmax(1), rounds + 1
    assert rounds > 101 and got.cluster.tolist() == y.tolist()
