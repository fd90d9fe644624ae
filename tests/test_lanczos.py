import os

import numpy as np

from manifold_spark.operators import lanczos, spectral
from manifold_spark.session import shared_dir


def test_eigenvectors_in_tiles_and_parts_equal_numpy_and_nothing_is_left(spark, monkeypatch):
    monkeypatch.setattr(lanczos, "PART", 16)
    monkeypatch.setattr(lanczos, "EDGES", 120)
    monkeypatch.setattr(lanczos, "CHUNK", 25)
    plans = []
    total = lanczos._total
    monkeypatch.setattr(lanczos, "_total", lambda found, size: plans.append(found._jdf.queryExecution().executedPlan().toString()) or total(found, size))
    rng = np.random.default_rng(5)
    m = np.where(rng.random((60, 60)) < 0.1, rng.random((60, 60)), 0.0)
    m = m + m.T + np.diag(np.arange(60) / 40)
    rows = [(int(7 * i), int(7 * j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    edges = spark.createDataFrame(rows, "i long, j long, w double")
    values, vectors = spectral.eigen(edges, 3, rounds=12, small=0)
    want, axes = np.linalg.eigh(m)
    order = np.argsort(-np.abs(want))[:3]
    order = order[np.argsort(-want[order])]
    assert np.allclose(values, want[order], atol=1e-7)
    x = np.array([r.x for r in vectors.orderBy("id").collect()])
    assert np.allclose(np.abs(x), np.abs(axes[:, order]), atol=1e-4)
    # the basis and the product lie by part already: no exchange but for the sums
    assert all(p.split("FlatMapCoGroups")[1].count("Exchange") == 0 for p in plans if "FlatMapCoGroups" in p) and len(plans) > 3
    # what the rounds wrote is gone
    left = os.listdir(shared_dir(spark).removeprefix("file://"))
    assert not [name for name in left if name.startswith(("basis-", "product-", "tiles-"))]
