import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
import tools_oracle
from manifold_spark.operators import graph, neighbours, sampling

SF = "/root/testdata/sf0.001"
CORE = __import__("manifold_spark.queries", fromlist=["QUERIES"])


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in tools_oracle.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(CORE.ORACLES))
def test_query_equals_sql(spark, con, name):
    ours = tools_oracle.normal(CORE.QUERIES[name](spark, SF).toPandas())
    theirs = tools_oracle.normal(con.execute(CORE.ORACLES[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, rtol=1e-6, atol=2e-6)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _matrix():
    return np.array(duckdb.connect().execute(f"SELECT embedding FROM read_parquet('{SF}/embeddings.parquet') ORDER BY vec_id").df()["embedding"].to_list(), dtype=float)


def test_anisotropy_and_local_spectrum_equal_numpy(spark):
    x = _matrix()
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert CORE.QUERIES["anisotropy"](spark, SF).first()[0] == pytest.approx(s[0] / s.sum(), abs=1e-5)
    got = {r.i: r for r in CORE.QUERIES["local_spectral_analysis"](spark, SF).collect()}
    for i in (0, 7, 99):
        near = np.argsort(np.linalg.norm(x - x[i], axis=1), kind="stable")[1:26]
        v = np.linalg.svd(x[near] - x[near].mean(0), compute_uv=False) ** 2
        assert got[i].participation == pytest.approx(v.sum() ** 2 / (v**2).sum(), abs=1e-4)
        assert got[i].dimension == int((np.cumsum(v) / v.sum() < 0.95).sum()) + 1


def test_knn_tiles_ties_and_clamping(spark):
    rows = [(i, [float(i // 2), 0.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    one = neighbours.knn(df, 3).orderBy("i", "rank").collect()
    assert one == neighbours.knn(df, 3, tile=5).orderBy("i", "rank").collect()
    assert [r.j for r in one if r.i == 0] == [1, 2, 3]
    assert neighbours.knn(df, 50).count() == 12 * 11
    assert neighbours.knn(df.limit(1), 3).count() == 0 and neighbours.knn(df.limit(0), 3).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_samples_have_exact_sizes(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 3 as string) as g", "double(id % 5) as w")
    assert sampling.random(df, "id", 100).count() == 100
    assert sampling.stratified(df, "id", "g", 100).count() == 100
    assert sampling.weighted(df, "id", "w", 50).where("w = 0").count() == 0
    jittered = sampling.density_spike(spark.createDataFrame([(1, [0.0]), (2, [9.0])], "id long, vec array<double>"), [0.0], 1.0, 4)
    assert [r.spike for r in jittered.orderBy("spike").collect()] == [0, 0, 1, 1, 1]
