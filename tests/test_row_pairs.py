import numpy as np
import pytest

from manifold_spark.operators import curvature


def test_balls_by_tiles_equal_numpy_without_a_table_of_pairs(spark, monkeypatch):
    names = []
    write = curvature.materialize
    monkeypatch.setattr(curvature, "materialize", lambda df, name: names.append((name, write(df, name))) or names[-1][1])
    monkeypatch.setattr(curvature, "ENTRIES", 60)
    monkeypatch.setattr(curvature, "PACK", 20)
    monkeypatch.setattr(curvature, "BLOCK", 40)
    monkeypatch.setattr(curvature, "BINS", 64)
    rng = np.random.default_rng(6)
    m = np.where(rng.random((50, 50)) < 0.12, rng.random((50, 50)), 0.0) + np.eye(50)
    m[40:] = m[:10]  # rows that repeat are at no distance
    rows = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, w double")
    d, shared = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)), (m @ m.T) > 0
    for percentile in (0.02, 0.3):
        cut = np.sort(d[shared])[int(np.ceil(percentile * shared.sum())) - 1]
        got = {r.i: r.curvature for r in curvature.ball_means(rows, percentile).collect()}
        want = {i: m[i][shared[i] & (d[i] <= cut + 1e-9)].mean() for i in range(50)}
        assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()), atol=1e-9)
        # what is written is less than the pairs
        assert names[-1][0] == "balls" and names[-1][1].where("d >= 0").count() < shared.sum() / 2


def test_balls_hold_rows_that_share_nothing_and_are_near(spark, monkeypatch):
    monkeypatch.setattr(curvature, "ENTRIES", 60)
    monkeypatch.setattr(curvature, "PACK", 20)
    monkeypatch.setattr(curvature, "BLOCK", 40)
    monkeypatch.setattr(curvature, "BINS", 64)
    rng = np.random.default_rng(6)
    m = np.where(rng.random((50, 50)) < 0.08, rng.random((50, 50)), 0.0) + np.diag(rng.choice([0.01, 1.0], 50))
    m[40:] = m[:10]
    rows = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, w double")
    d, shared = np.sqrt(((m[:, None] - m[None]) ** 2).sum(2)), (m @ m.T) > 0
    for percentile in (0.001, 0.05, 0.3, 0.9, 1.0):
        cut = np.sort(d.ravel())[int(np.ceil(percentile * d.size)) - 1]
        ball = d <= cut + 1e-9
        assert percentile < 0.05 or (ball & ~shared).any()
        got = {r.i: r.curvature for r in curvature.all_ball_means(rows, percentile).collect()}
        want = {i: m[i][ball[i]].mean() for i in range(50)}
        assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()), atol=1e-9)
    assert curvature.all_ball_means(rows.limit(0), 0.1).collect() == []
    alike = spark.createDataFrame([(i, i, 1.0) for i in range(6)], "i long, j long, w double")
    assert {r.curvature for r in curvature.all_ball_means(alike, 0.5).collect()} == {1 / 6}


def test_all_places_meet_once_in_tiles_and_neither_table_is_broadcast(spark):
    from pyspark.sql import functions as F

    from manifold_spark.operators import vectors

    rng = np.random.default_rng(7)
    rows = [(int(i), float(a), float(b)) for i, a, b in zip(rng.permutation(200)[:50] - 100, rng.uniform(-90, 90, 50), rng.uniform(-180, 180, 50), strict=True)]
    rows += [(500, None, 3.0), (501, rows[0][1], rows[0][2])]
    places = spark.createDataFrame(rows, "id long, lat double, lon double")
    found = vectors.all_haversine(places, tile=5, most=7)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.i, r.j): r.km for r in found.collect()}
    a, b = places, places.select(F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pairs = a.crossJoin(b).where("id < id2").select("id", "id2", vectors.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km"))
    want = {(r.id, r.id2): r.km for r in pairs.collect()}
    assert found.count() == len(want) == 52 * 51 // 2 and got == pytest.approx(want)
    assert vectors.all_haversine(places.limit(0)).count() == 0
