"""Whitening against a dense eigensolve of the distinct vectors."""

import math

import numpy as np
import pytest

from manifold_spark.llm import whitening


def frame(spark, vectors, more=None):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 7) for i, v in enumerate(vectors)] + (more or [])
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int")


def expected(vectors, k=4):
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors], dtype=np.int64)
    distinct = np.unique(x, axis=0)
    n, s = len(distinct), distinct.sum(0)
    c = distinct - s / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ turn / np.sqrt(values), values / np.trace(c.T @ c / n)


def check(got, vectors, ids, k=4):
    n, deviation, white, share = expected(vectors, k)
    table = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(table) == len(ids) * k
    for c in range(k):
        mine = np.array([table[i, c + 1].whitened for i in ids])
        sign = 1 if mine @ white[:, c] > 0 else -1
        assert np.abs(sign * mine - white[:, c]).max() < 1e-8
        assert abs(table[ids[0], c + 1].explained - share[c]) < 1e-10
    assert [table[i, 1].deviation for i in ids] == deviation.tolist()
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_flat_spectrum_takes_the_whole_space(spark):
    rng = np.random.default_rng(0)
    vectors = list(rng.normal(size=(300, 20)).astype(np.float32))
    vectors += vectors[:40]  # copies count once, but have rows
    df = frame(spark, vectors, [(900, None, 1), (901, [1.0, float("nan")] + [0.0] * 18, 1), (902, [float("inf")] * 20, 1), (903, [None] + [1.0] * 19, 1), (904, [], 1), (905, [1.0, 2.0], 1)])
    check(whitening.report(df).collect(), vectors, list(range(340)))


def test_steep_spectrum_stays_in_the_block(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(500, 30)) * 3.0 ** -np.arange(30) * 1000
    df, passes = frame(spark, list(vectors)), []
    real = whitening._summed
    monkeypatch.setattr(whitening, "_summed", lambda f, size, of: passes.append(size) or real(f, size, of))
    check(whitening.report(df).collect(), [np.float32(v) for v in vectors], list(range(500)))
    assert max(passes) == 30 * 12 + 1


def test_degenerate_tables(spark):
    assert whitening.report(frame(spark, [])).collect() == []
    assert whitening.report(frame(spark, [None, None])).collect() == []
    assert whitening.report(frame(spark, [[1.0, 2.0]] * 3)).collect() == []
    two = whitening.report(frame(spark, [[0.0, 1.0, 2.0], [1.0, 1.0, 2.0], [1.0, 1.0, 2.0]])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in two) == [(0, 1, 2, 256**2), (1, 1, 2, 256**2), (2, 1, 2, 256**2)]
    assert {abs(r.whitened) for r in two} == {1.0} and {r.explained for r in two} == {1.0}
    null_id = spark.createDataFrame([(None, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in whitening.report(null_id).collect()} == {None, 1}
    with pytest.raises(Exception, match="2 \\*\\* 53"):
        whitening.report(spark.createDataFrame([(1, [1e20]), (2, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_large_whole_numbers_are_exact(spark):
    rows = [(1, [2.0**22, 3.0]), (2, [2.0**22 + 1, 1.0]), (3, [2.0**22 - 2, 0.0])]
    got = {r.vec_id: r.deviation for r in whitening.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [[int(256 * c) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i + 1: sum((3 * c - t) ** 2 for c, t in zip(v, s, strict=True)) for i, v in enumerate(x)}
