import numpy as np
import pytest

from manifold_spark.operators import magnitude, neighbours, spectral
from manifold_spark.operators.graph import connected_components


def cloud(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "id long, vec array<double>")


def test_close_links_connect_as_all_close_pairs_do_and_are_few(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 120)
    x = np.random.default_rng(0).normal(size=(70, 2))
    x[40:] = x[0]  # thirty copies: 465 close pairs
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) < 0.3
    label = np.arange(70)
    while True:
        new = np.where(near, label[None, :], 99).min(1)
        if (new == label).all():
            break
        label = new
    links = spectral.close_links(cloud(spark, x), 0.3, tile=25).collect()
    assert len(links) < 465
    found = {r.node: r.component for r in connected_components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long"), "a", "b").collect()}
    assert [found.get(i, i) for i in range(70)] == label.tolist()


def test_kernels_of_even_scales_are_powers(monkeypatch):
    d = np.random.default_rng(1).random((5, 6)) * 3
    calls = []
    exp = np.exp
    monkeypatch.setattr(np, "exp", lambda v: calls.append(1) or exp(v))
    for scales, most in (([0.5, 1.0, 1.5, 2.0, 3.0, 4.0], 1), ([0.3, 0.71], 2)):
        calls.clear()
        got = {s: k.copy() for s, k in magnitude._kernels(d, np.array(scales))}
        assert len(calls) == most
        assert all(got[s] == pytest.approx(exp(-t * d), rel=1e-12) for s, t in enumerate(scales))
