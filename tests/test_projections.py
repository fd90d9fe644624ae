"""Projections, homology and robust parts against dense numpy."""

import itertools

import numpy as np
import pytest

from manifold_spark.operators import archetypes, correction, homology, local, magnitude, models, neighbours, phate, robust, sampling, scaling, spectral, tsne, umap


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [None if c is None else float(c) for c in v]) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)], "id long, vec array<double>")


def rows(df, name="vec"):
    return {r["id"]: np.array(r[name]) for r in df.collect()}


def pairwise(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


# scaling ------------------------------------------------------------------------------


@pytest.mark.parametrize("how", ["classic", "metric"])
def test_scaling_is_exact_for_euclidean_points(spark, how):
    rng = np.random.default_rng(0)
    x = np.pad(rng.normal(size=(60, 3)), ((0, 0), (0, 4))) @ np.linalg.qr(rng.normal(size=(7, 7)))[0] + 5
    table = frame(spark, [*x, None, [1.0], [float("nan")] * 7, x[0]])
    model = scaling.fit(table, 3, how=how, n_landmarks=12)
    got = rows(scaling.transform(table, model))
    assert sorted(got) == [*range(60), 63]
    y = np.array([got[i] for i in range(60)])
    assert np.allclose(pairwise(y), pairwise(x), atol=1e-5) and np.allclose(got[63], got[0])
    assert model.stress < 1e-9
    assert scaling.stress(table, scaling.transform(table, model), model).first()[0] < 1e-9


def test_majorising_lowers_the_stress(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6))
    table = frame(spark, x)
    classic, metric = scaling.fit(table, 2, how="classic"), scaling.fit(table, 2, how="metric")
    assert metric.stress < classic.stress
    of = lambda m: scaling.stress(table, scaling.transform(table, m), m).first()[0]
    assert of(metric) < of(classic)
    ordinal = scaling.fit(table, 2, how="nonmetric", n_landmarks=40, choose="farthest")
    assert len(ordinal.ids) == 40 and ordinal.stress < metric.stress and scaling.transform(table, ordinal).count() == 80
    cosine = scaling.fit(table, 2, how="classic", metric="cosine")
    assert cosine.stress < 1
    assert np.allclose(scaling.monotone(np.array([1.0, 3, 2, 2, 5, 4])), [1, 7 / 3, 7 / 3, 7 / 3, 4.5, 4.5])
    for bad in ({"how": "no"}, {"metric": "no"}, {"n_landmarks": 0}, {"choose": "no"}):
        with pytest.raises(ValueError, match="no|from"):
            scaling.fit(table, 2, **bad)


def test_scaling_of_few_points(spark):
    assert scaling.scale(frame(spark, []), 2).collect() == []
    assert rows(scaling.scale(frame(spark, [[3.0, 4.0]]), 2))[0].tolist() == [0.0, 0.0]
    two = rows(scaling.scale(frame(spark, [[0.0], [5.0], [0.0]]), 2))
    assert abs(np.linalg.norm(two[0] - two[1]) - 5) < 1e-6 and np.allclose(two[0], two[2])


# potential distances --------------------------------------------------------------------


def dense_kernel(x, k, decay, threshold=1e-4):
    d = pairwise(x)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    w = np.exp(-((d / np.take_along_axis(d, order[:, k - 1 : k], 1)) ** decay))
    first = np.zeros_like(d, bool)
    np.put_along_axis(first, order[:, :k], True, axis=1)
    w = np.where(first | (w >= threshold), w, 0)
    np.fill_diagonal(w, 0)
    w = (w + w.T) / 2
    np.fill_diagonal(w, 1)
    return w


def test_all_points_as_landmarks_equal_the_dense_operator(spark):
    x = np.random.default_rng(2).normal(size=(40, 3))
    table = frame(spark, x)
    w = dense_kernel(x, 5, 10.0)
    e = phate.kernel(table, 5, 10.0, reach=39)
    got = np.zeros((40, 40))
    for r in e.collect():
        got[r.i, r.j] += r.w
    assert np.allclose(got, w, atol=1e-12)
    _, operator = phate.transition(e, phate.assigned(table, 40))
    p = w / w.sum(1, keepdims=True)
    assert np.allclose(operator, p)
    u = -np.log(np.linalg.matrix_power(p, 4) + 1e-7)
    assert np.allclose(phate.potential(operator, 4), pairwise(u))
    y = rows(phate.embed(table, 2, t=4, decay=10.0, n_landmarks=40, how="classic"))
    want, _ = scaling.classical(pairwise(-np.log(np.linalg.matrix_power(dense_kernel(x, 5, 10.0) / dense_kernel(x, 5, 10.0).sum(1, keepdims=True), 4) + 1e-7)), 2)
    assert np.allclose(np.array([y[i] for i in range(40)]), want, atol=1e-6)


def test_landmarks_equal_dense_sums(spark):
    x = np.random.default_rng(3).normal(size=(50, 3))
    table = frame(spark, x)
    w = dense_kernel(x, 5, 10.0)
    landmark = phate.assigned(table, 8)
    of = {r.id: r.landmark for r in landmark.collect()}
    pmn = np.zeros((8, 50))
    for i in range(50):
        pmn[of[i]] += w[i]
    pnm = pmn.T / pmn.T.sum(1, keepdims=True)
    pmn = pmn / pmn.sum(1, keepdims=True)
    steps, operator = phate.diffusion(phate.kernel(table, 5, 10.0, reach=49), landmark)
    assert np.allclose(operator, pmn @ pnm)
    got = np.zeros((50, 8))
    for r in steps.collect():
        got[r.i, r.landmark] = r.p
    assert np.allclose(got, pnm)
    y = phate.embed(table, 2, n_landmarks=8)
    assert y.count() == 50 and all(np.isfinite(v).all() for v in rows(y).values())
    assert phate.embed(table, 2, n_landmarks=8, choose="spectral").count() == 50
    assert phate.embed(frame(spark, []), 2).collect() == []


def test_entropy_and_knee():
    op = np.diag([1.0, 0.5])
    e = phate.entropy(op, 3)
    p = np.array([1, 0.25]) / 1.25
    assert e[1] == pytest.approx(-(p * np.log(p)).sum())
    assert phate.knee(np.array([10.0, 7, 4, 1, 0.9, 0.8, 0.7, 0.6])) == 3


# robust parts -----------------------------------------------------------------------------


def planted(n=200, d=40, rank=3, share=0.05, seed=0):
    rng = np.random.default_rng(seed)
    low = rng.normal(size=(n, rank)) @ rng.normal(size=(rank, d))
    sparse = np.where(rng.random((n, d)) < share, rng.choice([-1, 1], (n, d)) * 10, 0.0)
    return low, sparse


@pytest.mark.parametrize("solver", ["ialm", "admm"])
def test_planted_parts_are_found(spark, solver):
    low, sparse = planted()
    got = robust.decompose(frame(spark, low + sparse), solver, tolerance=1e-6)
    l_, s = rows(got.table, "low"), rows(got.table, "sparse")
    error = lambda a, b: np.linalg.norm(np.array([a[i] for i in range(200)]) - b) / np.linalg.norm(b)
    assert got.rank == 3 and error(l_, low) < 0.05 and error(s, sparse) < 0.02
    assert got.errors[-1] < 1e-6 and len(got.errors) == len(got.ranks) == got.rounds > 10


def test_parts_equal_a_dense_solver(spark):
    low, sparse = planted(60, 10, 2)
    x = low + sparse
    weight, mu = 1 / np.sqrt(60), 1e-5
    y = x / max(np.linalg.norm(x, 2), np.abs(x).sum(1).max() / weight)
    s = np.zeros_like(x)
    for _ in range(25):
        u, sigma, vt = np.linalg.svd(x - s + y / mu, full_matrices=False)
        l_ = (u * np.maximum(sigma - 1 / mu, 0)) @ vt
        s = robust.shrink(x - l_ + y / mu, weight / mu)
        y = y + mu * (x - l_ - s)
        mu = min(1.5 * mu, 1e7)
    got = robust.decompose(frame(spark, x), rounds=25, tolerance=0, every=7)
    assert np.allclose(np.array([rows(got.table, "low")[i] for i in range(60)]), l_, atol=1e-6)
    assert np.allclose(np.array([rows(got.table, "sparse")[i] for i in range(60)]), s, atol=1e-6)


def test_noise_zeros_and_empty(spark):
    low, sparse = planted(80, 12, 2)
    noise = np.random.default_rng(9).normal(size=(80, 12)) * 0.05
    got = robust.decompose(frame(spark, low + sparse + noise), delta=np.linalg.norm(noise))
    assert got.errors[-1] * np.linalg.norm(low + sparse + noise) <= np.linalg.norm(noise)
    zero = robust.decompose(frame(spark, np.zeros((4, 3))))
    assert zero.rank == zero.rounds == 0 and zero.table.count() == 4
    assert robust.decompose(frame(spark, [None])).table.collect() == []
    assert robust.robust_pca(frame(spark, low + sparse), 2).count() == 80
    with pytest.raises(ValueError, match="no solver"):
        robust.decompose(frame(spark, low), "svd")


# homology ---------------------------------------------------------------------------------


def brute_bars(x):
    """Reduction of the whole boundary matrix, column by column."""
    n = len(x)
    d = pairwise(x)
    simplices = [((i,), 0.0) for i in range(n)] + [(s, max(d[a, b] for a, b in itertools.combinations(s, 2))) for k in (2, 3) for s in itertools.combinations(range(n), k)]
    simplices.sort(key=lambda s: (s[1], len(s[0]), s[0]))
    place = {s: i for i, (s, _) in enumerate(simplices)}
    low, out = {}, []
    for s, death in simplices:
        column = {place[f] for f in itertools.combinations(s, len(s) - 1)} if len(s) > 1 else set()
        while column and max(column) in low:
            column ^= low[max(column)]
        if column:
            low[max(column)] = column
            birth = simplices[max(column)]
            if death > birth[1]:
                out.append((len(birth[0]) - 1, birth[1], death))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_bars_equal_a_whole_reduction(spark, seed):
    rng = np.random.default_rng(seed)
    angle = rng.random(22) * 2 * np.pi
    x = np.stack([np.cos(angle), np.sin(angle)], 1) + rng.normal(size=(22, 2)) * 0.1 if seed else np.array(list(itertools.product(range(5), range(4))), float)
    got = sorted((r.dimension, r.birth, r.death) for r in homology.bars(frame(spark, x)).collect())
    want = brute_bars(x)
    assert len(got) == len(want) and np.allclose(np.array(got), np.array(want))


def test_circle_torus_and_samples(spark):
    t = np.arange(60) * 2 * np.pi / 60
    circle = homology.bars(frame(spark, np.stack([np.cos(t), np.sin(t)], 1)))
    assert homology.persistent_features(circle, 1, 0.5).first().n == 1
    a, b = np.meshgrid(np.arange(18) * 2 * np.pi / 18, np.arange(10) * 2 * np.pi / 10)
    torus = np.stack([np.cos(a), np.sin(a), 0.6 * np.cos(b), 0.6 * np.sin(b)], -1).reshape(-1, 4)
    assert homology.persistent_features(homology.bars(frame(spark, torus)), 1, 0.4).first().n == 2
    assert homology.persistent_features(circle, 1, 0.5, relative=True).first().n == 1
    assert homology.bars(frame(spark, np.random.default_rng(0).normal(size=(50, 2))), most=20).where("dimension = 0").count() == 19
    for few in ([], [[1.0]], [None]):
        assert homology.bars(frame(spark, few)).collect() == []
    assert homology.persistent_features(homology.bars(frame(spark, [])), 1).first().n == 0
    assert [tuple(r) for r in homology.bars(frame(spark, [[0.0], [2.0], [2.0]])).collect()] == [(0, 0.0, 2.0)]


# layouts ----------------------------------------------------------------------------------


def test_bandwidths_and_graph(spark):
    x = np.random.default_rng(4).normal(size=(40, 3))
    e = {(r.i, r.j): r.w for r in umap.fuzzy_graph(frame(spark, x), 8).collect()}
    d = pairwise(x)
    np.fill_diagonal(d, np.inf)
    one = np.zeros((40, 40))
    for i in range(40):
        near = np.argsort(d[i], kind="stable")[:8]
        rho, (lo, hi) = d[i, near[0]], (1e-9, 100.0)
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if np.exp(-(d[i, near] - rho) / mid).sum() > 3 else (mid, hi)
        one[i, near] = np.exp(-(d[i, near] - rho) / mid)
    want = one + one.T - one * one.T
    assert set(e) == set(zip(*np.nonzero(want), strict=True))
    assert all(e[k] == pytest.approx(want[k], abs=1e-6) for k in e)
    a, b = umap.curve(0.1)
    assert a == pytest.approx(1.577, abs=5e-3) and b == pytest.approx(0.895, abs=5e-3)


def test_layout_keeps_clusters_apart(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(25, 8)) + c for c in (0, 6, 12)])
    y = umap.embed(frame(spark, x), 2, 8, rounds=12)
    v = np.array([rows(y)[i] for i in range(75)])
    d, label = pairwise(v), np.repeat(np.arange(3), 25)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :5]
    assert (label[near] == label[:, None]).mean() > 0.95
    assert umap.embed(frame(spark, []), 2).collect() == []


def test_tsne_gradient_and_layout(spark):
    rng = np.random.default_rng(16)
    x = np.concatenate([rng.normal(size=(60, 5)), rng.normal(size=(60, 5)) + 8])
    p = tsne.affinities(frame(spark, x), perplexity=10)
    m = np.zeros((120, 120))
    for r in p.collect():
        m[r.i, r.j] += r.p
    assert m.sum() == pytest.approx(1) and np.allclose(m, m.T)
    d = pairwise(x)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d[0], kind="stable")[:30]
    beta = tsne.precisions(d[0][near][None] ** 2, 10)[0]
    q = np.exp(-beta * d[0][near] ** 2)
    q /= q.sum()
    assert np.exp(-(q * np.log(q)).sum()) == pytest.approx(10, rel=1e-4)
    y = rng.normal(size=(120, 2)) * 7
    k = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(-1))
    np.fill_diagonal(k, 0)
    far = y[:, None] - y[None]
    want = 4 * (((m * k)[..., None] * far).sum(1) - ((k * k)[..., None] * far).sum(1) / k.sum())
    got = rows(tsne.gradient(spectral.materialize(p, "p"), frame(spark, y), intervals=100))
    g = np.array([got[i] for i in range(120)])
    assert np.linalg.norm(g - want) / np.linalg.norm(want) < 1e-2
    out = rows(tsne.embed(frame(spark, x), perplexity=10, rounds=12))
    v = np.array([out[i] for i in range(120)])
    dist, label = pairwise(v), np.repeat([0, 1], 60)
    np.fill_diagonal(dist, np.inf)
    assert (label[np.argsort(dist, axis=1)[:, :5]] == label[:, None]).mean() > 0.95
    assert tsne.embed(frame(spark, [])).collect() == [] and tsne.embed(frame(spark, [[1.0, 2.0]])).count() == 1


def test_numbers_are_dense(spark):
    got, n = umap.numbered(spark.range(100).repartition(7))
    assert n == 100 and sorted(r.number for r in got.collect()) == list(range(100))


# patches ----------------------------------------------------------------------------------


def test_local_spectra_equal_numpy(spark):
    x = np.random.default_rng(12).normal(size=(40, 4)) * [3, 2, 0.1, 0.05]
    d = pairwise(x)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    got = {r.id: r for r in local.local_pca(frame(spark, [*x, None]), 10, method="none").collect()}
    trimmed = {r.id: r for r in local.local_pca(frame(spark, x), 10, method="trimmed", trim=0.2).collect()}
    assert len(got) == 40
    for i in range(40):
        p = x[near[i]]
        values = np.linalg.eigvalsh(np.cov(p.T))[::-1]
        assert np.allclose(got[i]["values"], values) and got[i].support == 10
        m = int(np.argmax(np.log(values[:-1] / values[1:]))) + 1
        assert got[i].dimension == m and got[i].variance == pytest.approx(values[:m].sum()) and got[i].condition == pytest.approx(values[0] / values[m - 1])
        q = values / values.sum()
        assert got[i].effective_rank == pytest.approx(np.exp(-(q * np.log(q)).sum()))
        keep = np.argsort(np.linalg.norm(p - np.median(p, axis=0), axis=1), kind="stable")[:8]
        assert np.allclose(trimmed[i]["values"], np.linalg.eigvalsh(np.cov(p[keep].T))[::-1]) and trimmed[i].support == 8
    with pytest.raises(ValueError, match="no method"):
        local.local_pca(frame(spark, x), method="x")


@pytest.mark.parametrize("method", ["trimmed", "mcd", "huber"])
def test_robust_covariances_withstand_outliers(method):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 30, 3)) * [3, 1, 0.01]
    bad = x.copy()
    bad[:, :2] += [0, 0, 50]
    plain, _ = local.covariances(bad, np.ones((5, 30)), "none")
    cov, keep = local.covariances(bad, np.ones((5, 30)), method)
    # Huber's weights bound an outlier's pull, the others leave it out
    assert not keep[:, :2].any() and (cov[:, 2, 2] < plain[:, 2, 2] * (0.75 if method == "huber" else 0.1)).all()


def test_tangent_alignment_unrolls_a_roll(spark):
    rng = np.random.default_rng(13)
    t, h = 1.5 * np.pi * (1 + 1.2 * rng.random(500)), 12 * rng.random(500)
    x = np.stack([t * np.cos(t), h, t * np.sin(t)], 1)
    table = frame(spark, x)
    y = rows(local.align_tangents(table, 12, 2))
    v = np.array([y[i] for i in range(500)])
    # arc length and height are linear in the coordinates
    arc = 0.5 * (t * np.sqrt(1 + t * t) + np.arcsinh(t))
    a = np.column_stack([v, np.ones(500)])
    for truth in (arc, h):
        left = truth - a @ np.linalg.lstsq(a, truth, rcond=None)[0]
        assert 1 - left.var() / truth.var() > 0.95
    b = np.zeros((500, 500))
    for r in local.alignment(table, 12, 2).collect():
        b[r.i, r.j] += r.w
    values, vectors = np.linalg.eigh(b)
    own = vectors[:, 1:3]
    assert np.allclose(own @ own.T, v @ v.T, atol=1e-5)
    assert local.align_tangents(frame(spark, [])).collect() == []


def test_archetypes_are_the_planted_corners(spark):
    rng = np.random.default_rng(14)
    corners = np.array([[0.0, 0, 0], [10, 0, 1], [0, 10, 2]])
    x = np.concatenate([corners, rng.dirichlet([1, 1, 1], 150) @ corners])
    table = frame(spark, [*x, None, [1.0]])
    got, loss = archetypes.fit(table, 3)
    assert loss < 1e-3 and max(np.linalg.norm(got - c, axis=1).min() for c in corners) < 0.25
    shares = rows(archetypes.transform(table, got))
    assert len(shares) == 153 and all(v.min() >= 0 and abs(v.sum() - 1) < 1e-9 for v in shares.values())
    assert archetypes.analyse(frame(spark, []), 3).collect() == []
    assert archetypes.fit(frame(spark, [[1.0, 2.0]] * 4), 3)[0].tolist() == [[1.0, 2.0]]
    p = rng.normal(size=(20, 5))
    q = archetypes.on_simplex(p)
    assert np.allclose(q.sum(1), 1) and (q >= 0).all()
    other = rng.dirichlet(np.ones(5), (400, 20))
    assert (((other - p) ** 2).sum(-1) >= ((q - p) ** 2).sum(-1) - 1e-12).all()


def test_condensation_sampling_is_balanced(spark):
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(0, 0.2, (30, 2)), rng.normal(8, 0.2, (10, 2))])
    got = {r.id for r in sampling.condensed(frame(spark, x), target=2, scale=1.6, rounds=25).collect()}
    a, b = sum(i < 30 for i in got), sum(i >= 30 for i in got)
    assert b == 10 and 10 <= a <= 20


# correction -------------------------------------------------------------------------------


def loss_of(x, edges, moving):
    total = 0.0
    for i in moving:
        lx, ly = np.array([e[2] for e in edges[i]]), np.array([np.log(np.linalg.norm(x[i] - x[e[1]])) for e in edges[i]])
        total += 1 - np.corrcoef(lx, ly)[0, 1] ** 2
    return total


def test_only_flagged_points_move_and_fit_better(spark):
    x = np.random.default_rng(17).normal(size=(50, 2))
    table = frame(spark, x)
    edges = spectral.materialize(correction.scale_edges(table, 20, 2, 8), "edges")
    by = {i: [(r.i, r.j, r.x) for r in edges.collect() if r.i == i] for i in range(50)}
    moving = [3, 7, 20, 41]
    mine = edges.where(f"i in ({','.join(map(str, moving))})")
    g = rows(correction.gradient(mine, table), "g")
    for i in (3, 41):
        for c in (0, 1):
            step = np.zeros_like(x)
            step[i, c] = 1e-6
            slope = (loss_of(x + step, by, moving) - loss_of(x - step, by, moving)) / 2e-6
            assert g[i][c] == pytest.approx(slope, rel=1e-4, abs=1e-6)
    quality = {r.i: r.r2 for r in correction.fit_quality(mine, table).collect()}
    assert sum(1 - v for v in quality.values()) == pytest.approx(loss_of(x, by, moving))
    flagged = spark.createDataFrame([(i, i in moving) for i in range(50)], "id long, mismatched boolean")
    out = rows(correction.correct(table, flagged, 20, 2, 8, steps=6, rate=0.02))
    y = np.array([out[i] for i in range(50)])
    still = [i for i in range(50) if i not in moving]
    assert (y[still] == x[still]).all() and (y[moving] != x[moving]).any(axis=1).all()
    assert loss_of(y, by, moving) < loss_of(x, by, moving)
    assert rows(correction.correct(table, flagged.withColumn("mismatched", flagged.mismatched & False), 20)).keys() == set(range(50))
    assert correction.correct(frame(spark, []), flagged, 20).collect() == []


def test_all_steps_equal_those_of_joins_in_one_tile_and_in_several(spark):
    x = np.random.default_rng(18).normal(size=(60, 2))
    table = frame(spark, x)
    moving = set(range(0, 60, 2))
    flagged = spark.createDataFrame([(i, i in moving) for i in range(60)], "id long, mismatched boolean")
    edges = spectral.materialize(correction.scale_edges(table, 20, 2, 8).where("i % 2 = 0"), "edges")
    want, m, v = x.copy(), np.zeros_like(x), np.zeros_like(x)
    for step in range(1, 4):
        g = np.zeros_like(x)
        for i, row in rows(correction.gradient(edges, frame(spark, want)), "g").items():
            g[i] = row
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        want[::2] -= (0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))[::2]
    for most in (1000, 60):
        got = rows(correction.correct(table, flagged, 20, 2, 8, steps=3, rate=0.02, most=most))
        assert np.allclose([got[i] for i in range(60)], want, rtol=0, atol=1e-10)


def test_selective_correction_goes_all_its_steps(spark, monkeypatch):
    from manifold_spark import projection_queries

    turns = []
    monkeypatch.setattr(correction, "correct", lambda embedding, flagged, **settings: turns.append(settings) or embedding)
    projection_queries.selective_correction(spark, "/root/testdata/sf0.001")
    assert turns == [{}]


# magnitude --------------------------------------------------------------------------------


def test_magnitudes_equal_dense_solves(spark):
    x = np.random.default_rng(18).normal(size=(40, 3))
    table = frame(spark, [*x, x[0], None, [1.0]])
    scales = [0.8, 2.0, 6.0]
    got = {r.scale: r.magnitude for r in magnitude.magnitudes(table, scales, tile=17).collect()}
    want = {t: np.linalg.solve(np.exp(-t * pairwise(x)), np.ones(40)).sum() for t in scales}
    assert all(got[t] == pytest.approx(want[t], rel=1e-6) for t in scales)
    slope = [r.dimension for r in magnitude.profile(magnitude.magnitudes(table, scales)).orderBy("scale").collect()]
    assert slope[0] is None and slope[1] == pytest.approx(np.log(want[2.0] / want[0.8]) / np.log(2.5), rel=1e-5)
    assert magnitude.magnitudes(frame(spark, []), [1.0]).collect() == []
    assert magnitude.magnitudes(frame(spark, [[1.0], [1.0]]), [3.0]).first().magnitude == pytest.approx(1)
    with pytest.raises(ValueError, match="above 0"):
        magnitude.magnitudes(table, [0.0])


# fitted models ----------------------------------------------------------------------------


def test_pca_and_models_survive_a_file(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(50, 5)) * [5, 3, 1, 1, 1]
    table = frame(spark, [*x, None])
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    model = models.fit_pca(table, 2)
    assert np.allclose(model.values, s[:2] ** 2 / 49)
    got = np.array([rows(model.transform(table))[i] for i in range(50)])
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ vt[:2].T))
    part = models.fit_pca(table, 2, fit_fraction=0.5)
    assert part.transform(table).count() == 50
    for i, m in enumerate((model, models.fit_scaling(table, 2, n_landmarks=10), models.fit_diffusion(table, 2, 6))):
        models.save(spark, m, str(tmp_path / str(i)))
        again = rows(models.load(spark, str(tmp_path / str(i))).transform(table))
        assert all(np.allclose(again[k], v) for k, v in rows(m.transform(table)).items()) and len(again) == 50


def test_fitted_points_keep_their_diffusion_coordinates(spark):
    rng = np.random.default_rng(7)
    t = np.sort(rng.random(60)) * 4
    x = np.stack([np.cos(t), np.sin(t), t], 1)
    table = frame(spark, x)
    model = models.fit_diffusion(table, 2, 8)
    near = spectral.diffusion_coordinates(spectral.materialize(spectral.gaussian_edges(table, 8), "e"), 2)
    want, own = rows(near), rows(model.transform(table))
    assert all(np.allclose(own[i], want[i], atol=1e-6) for i in range(60))
    # a new point beside a fitted one is placed near it
    new = rows(model.transform(frame(spark, x + 1e-4, range(100, 160))))
    v = np.array([own[i] for i in range(60)])
    off = np.array([np.linalg.norm(new[100 + i] - own[i]) for i in range(60)])
    assert off.mean() < 0.15 * v.std() * 2


def test_algorithms_by_name(spark):
    x = np.random.default_rng(8).normal(size=(40, 4))
    table = frame(spark, x)
    assert {"pca", "mds", "phate", "umap", "diffusion_map", "robust_pca", "leiden"} <= set(models.list_algorithms())
    assert "leiden" not in models.list_algorithms("projection")
    for name, more in (("PCA", {}), ("multidimensional_scaling", {"n_landmarks": 10}), ("noop", {}), ("kmeans", {"k": 3}), ("communities", {"neighbours": 5})):
        assert models.run_algorithm(table, name, **more).count() == 40
    with pytest.raises(KeyError, match="no algorithm"):
        models.get_algorithm("nothing")


# neighbours of odd vectors ------------------------------------------------------------------


def test_large_and_ragged_vectors_have_neighbours(spark):
    big = frame(spark, [[1e200], [1.1e200], [1.3e200], [1.7e200], [3e200], None, [1.0, 2.0]])
    got = {(r.i, r.rank): r.j for r in neighbours.knn(big, 2).collect()}
    assert len(got) == 10 and got[0, 1] == 1 and got[4, 1] == 3 and got[2, 1] == 1
    assert neighbours.knn(frame(spark, [[1.0, 2.0], [3.0]]), 1).collect() == []
