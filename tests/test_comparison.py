import math

import numpy as np
import pytest

from manifold_spark.functions import registry
from manifold_spark.operators import comparison
from manifold_spark.sources import synthetic

POINTS = "id long, vec array<double>"


def _cloud(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], POINTS)


def test_pca_equals_numpy(spark):
    x = np.random.default_rng(0).normal(size=(60, 5)) * [5, 3, 1, 1, 1] + 7
    got = np.array([r.vec for r in comparison.pca(_cloud(spark, x), 2).orderBy("id").collect()])
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    signs = np.sign(v[np.arange(2), abs(v[:2]).argmax(1)])
    assert np.allclose(got, (x - x.mean(0)) @ v[:2].T * signs, atol=1e-6)


def test_rbf_cka_equals_matrices(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 4)), rng.normal(size=(30, 3))

    def centred(x):
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        k = np.exp(-d / np.median(d[d > 0]))
        h = np.eye(len(x)) - 1 / len(x)
        return h @ k @ h

    k, l = centred(x), centred(y)
    want = (k * l).sum() / np.sqrt((k * k).sum() * (l * l).sum())
    assert comparison.rbf_cka(_cloud(spark, x), _cloud(spark, y)).first().cka == pytest.approx(want)
    assert comparison.rbf_cka(_cloud(spark, x), _cloud(spark, x)).first().cka == pytest.approx(1)


def test_axis_of_other_folds_shows_no_signal_in_noise(spark):
    x = np.random.default_rng(2).normal(size=(200, 40))
    sides = spark.range(200).selectExpr("id", "cast(id % 2 as int) as side")
    own = comparison.separation_auroc(_cloud(spark, x), sides).first().auc
    held_out = comparison.separation_auroc(_cloud(spark, x), sides, folds=5).first().auc
    assert own > 0.7 and 0.3 < held_out < 0.65
    x[1::2] += 1
    assert comparison.separation_auroc(_cloud(spark, x), sides, folds=5).first().auc > 0.9


def test_kmeans_finds_blobs(spark):
    p = synthetic.blobs(spark, [40, 30, 20], dim=4, spread=0.2)
    assert [r["count"] for r in p.groupBy("label").count().orderBy("label").collect()] == [40, 30, 20]
    found = comparison.kmeans(p.select("id", "vec"), 3).join(p, "id")
    assert comparison.adjusted_rand(found, "cluster", "label").first().ari == pytest.approx(1)


def test_constant_and_empty_input(spark):
    one = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 3.0)], "k long, x double, y double")
    assert comparison.kendall(one, "k", "x", "y").first().kendall is None
    assert comparison.adjusted_rand(one.limit(0), "x", "y").first().ari == 1.0
    interval = comparison.bootstrap_mean(one.limit(0), "k", "x").first()
    assert interval.low is None and interval.high is None
    assert comparison.bootstrap_mean(one, "k", "x").first().low == 1.0


def test_registry(spark):
    assert {"cka", "CKA", "lid", "trustworthiness"} <= set(registry.list_metrics())
    x = _cloud(spark, np.random.default_rng(3).normal(size=(40, 3)))
    got = {r.metric: r.value for r in registry.evaluate(x, x, {"continuity": {"k": 5}, "CKA": {}, "trustworthiness": {"k": 5}}).collect()}
    assert got == pytest.approx({"continuity": 1, "CKA": 1, "trustworthiness": 1})
    with pytest.raises(KeyError):
        registry.evaluate(x, x, {"unknown": {}})


def test_kendall_counts_all_pairs_without_making_them(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 150)), int(rng.integers(0, 6)) if i % 9 else None, float(rng.integers(0, 40)) if i % 11 else None) for i in range(200)]
    rows += [(None, 1, 2.0), (151, 2**53, 5.0), (152, 2**53 + 1, 6.0)]
    df = spark.createDataFrame(rows, "k long, x long, y double").repartition(3)
    sign = lambda d: (d > 0) - (d < 0)
    known = [r for r in rows if r[0] is not None]
    pairs = [(p, q) for i, p in enumerate(known) for q in known[:i] if p[0] != q[0]]
    one, two = (sum(abs(sign(p[c] - q[c])) for p, q in pairs if p[c] is not None and q[c] is not None) for c in (1, 2))
    s = sum(sign(p[1] - q[1]) * sign(p[2] - q[2]) for p, q in pairs if None not in (*p, *q))
    for tile in (1000, 40):
        assert comparison.kendall(df, "k", "x", "y", tile=tile).first().kendall == pytest.approx(s / math.sqrt(one * two), rel=1e-12)
    for values in ([], [(1, 1, 2.0)], [(1, 1, 2.0), (1, 2, 3.0)], [(1, 1, None), (2, 2, None)]):
        assert comparison.kendall(spark.createDataFrame(values, df.schema), "k", "x", "y").first().kendall is None
    odd = [(1, 1, float("nan")), (2, 2, 3.0), (3, 1, 1.0)], [(1, 1, float("inf")), (2, 2, float("inf")), (3, 1, 1.0)]
    assert all(math.isnan(comparison.kendall(spark.createDataFrame(v, df.schema), "k", "x", "y").first().kendall) for v in odd)
    # a second's work for pairs that a join of all would need hours for
    large = spark.range(300_000).selectExpr("id as k", "id % 25 as x", "pmod(id * 7919, 300007) * 1.0D as y")
    assert abs(comparison.kendall(large, "k", "x", "y").first().kendall) < 0.1
