"""Local principal components, robust ones as well, and the alignment of tangent spaces.

A patch is a point's ``k`` neighbours with their vectors, one row; tasks solve all
patches of a batch at once. The alignment matrix of all patches is an edge table,
summed by its two ends; its smallest eigenvectors are the largest of the matrix
taken from a multiple of the identity that bounds its values.

Points that take no part in the neighbour graph have no patch and no place. With
fewer points than ``k`` + 1, patches are smaller. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .neighbours import common_length, knn, same_length
from .spectral import arrays, eigen, matrix

#: Numbers in the points and covariances of the patches that a task solves together.
SOLVED = 2_000_000

METHODS = ("none", "trimmed", "mcd", "huber", "gaussian")


def patches(table: DataFrame, k: int) -> DataFrame:
    """id, near (neighbours' ids, nearest first), d (their distances) and x (their vectors one after another)."""
    points = same_length(table)
    e = knn(points, k).join(points.select(F.col("id").alias("j"), "vec"), "j")
    rows = e.groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "j", "d", "vec"))).alias("e"))
    of = lambda c: F.transform("e", lambda r: r[c])
    return rows.select("id", of("j").alias("near"), of("d").alias("d"), F.flatten(of("vec")).alias("x"))


def _weighted(x: np.ndarray, w: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of patches (b, k, d) with weights (b, k), divided by ``by``."""
    mean = (w[..., None] * x).sum(1) / np.maximum(w.sum(1), 1e-300)[:, None]
    c = x - mean[:, None]
    return mean, np.einsum("bk,bki,bkj->bij", w, c, c) / np.maximum(by, 1e-300)[:, None, None]


def _mahalanobis(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    c = x - mean[:, None]
    inverse = np.linalg.pinv(cov + 1e-10 * np.eye(x.shape[2]), hermitian=True)
    return np.sqrt(np.maximum(np.einsum("bki,bij,bkj->bk", c, inverse, c), 0))


def covariances(x: np.ndarray, d: np.ndarray, method: str = "trimmed", trim: float = 0.1, support: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """Covariances of patches and which of their points count.

    ``trimmed`` leaves out the share ``trim`` that is farthest from the median of each
    entry; ``mcd`` takes the share ``support`` of the least determinant, from the trimmed
    start by concentration steps; ``huber`` weighs down what is beyond the 95th percentile
    of a normal sample; ``gaussian`` weighs by the distance to the point. ``mcd`` and
    ``huber`` need more points than entries and are ``trimmed`` otherwise.
    """
    b, k, dim = x.shape
    every = np.ones((b, k), bool)
    if method == "none" or k < 2:
        return _weighted(x, every.astype(float), np.full(b, max(k - 1, 1)))[1], every
    if method == "gaussian":
        square = d**2
        w = np.exp(-square / np.maximum(np.median(square, axis=1), 1e-20)[:, None])
        return _weighted(x, w, w.sum(1))[1], w >= 0.1 / k

    def nearest(size: int, far: np.ndarray) -> np.ndarray:
        keep = np.zeros((b, k), bool)
        np.put_along_axis(keep, np.argsort(far, axis=1, kind="stable")[:, :size], True, axis=1)
        return keep

    keep = nearest(max(2, k - int(trim * k)), np.sqrt(((x - np.median(x, axis=1, keepdims=True)) ** 2).sum(2)))
    if method == "trimmed" or k <= dim:
        return _weighted(x, keep.astype(float), keep.sum(1) - 1.0)[1], keep
    if method == "mcd":
        size = min(k, max(dim + 1, int(support * k)))
        for _ in range(20):
            mean, cov = _weighted(x, keep.astype(float), keep.sum(1) - 1.0)
            new = nearest(size, _mahalanobis(x, mean, cov))
            if (new == keep).all():
                break
            keep = new
        return _weighted(x, keep.astype(float), keep.sum(1) - 1.0)[1], keep
    # the 95th percentile of chi-square by Wilson and Hilferty's cube
    cut = np.sqrt(dim * (1 - 2 / (9 * dim) + 1.6448536269514722 * np.sqrt(2 / (9 * dim))) ** 3)
    mean, cov = _weighted(x, every.astype(float), np.full(b, max(k - 1.0, 1.0)))
    for _ in range(20):
        far = _mahalanobis(x, mean, cov)
        w = np.where(far <= cut, 1.0, cut / np.maximum(far, 1e-10))
        new, cov = _weighted(x, w, w.sum(1))
        moved, mean = np.abs(new - mean).max(), new
        if moved < 1e-4:
            break
    return cov, _mahalanobis(x, mean, cov) <= cut


def dimensions(values: np.ndarray) -> np.ndarray:
    """The place of the widest gap between the logarithms of falling eigenvalues; 1 where there is none."""
    log = np.log(np.maximum(values, 1e-300))
    known = values[:, 1:] > 1e-10 * np.maximum(values[:, :1], 1e-300)
    gaps = np.where(known, log[:, :-1] - log[:, 1:], 0.0)
    # what follows the last positive value is a gap as wide as the largest that counts
    last = (values > 1e-10 * np.maximum(values[:, :1], 1e-300)).sum(1)
    place = gaps.argmax(1) + 1 if gaps.shape[1] else np.ones(len(values), np.int64)
    full = (last < values.shape[1]) & (gaps.max(1, initial=0.0) < np.log(1e2))
    return np.where(full, np.maximum(last, 1), place)


def _check(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"no method {method}; there are {', '.join(METHODS)}")


def _solved(batch: pa.RecordBatch, dim: int, method: str, trim: float, support: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the patches of a batch, those of one size at a time: their rows, points (b, k, d), falling values, axes and what counts; a bounded number of numbers at once."""
    size = batch.column("near").value_lengths().to_numpy()
    for k in np.unique(size):
        every = np.flatnonzero(size == k)
        step = max(1, SOLVED // (dim * (dim + int(k))))
        for at in range(0, len(every), step):
            rows = every[at : at + step]
            part = batch.take(pa.array(rows))
            x = matrix(part.column("x")).reshape(len(rows), k, dim)
            cov, keep = covariances(x, matrix(part.column("d")), method, trim, support)
            values, axes = np.linalg.eigh(cov)
            yield rows, x, np.maximum(values[:, ::-1], 0.0), axes[:, :, ::-1], keep


_LOCAL = "id long, values array<double>, dimension int, variance double, condition double, support int, effective_rank double, basis array<double>"


def local_pca(table: DataFrame, k: int = 20, components: int | None = None, method: str = "trimmed", trim: float = 0.1, support: float = 0.75) -> DataFrame:
    """Each point's local spectrum: id, values (falling), dimension (given, or by the widest gap), variance in it, condition number (null if infinite), how many neighbours count, effective rank (exp of the entropy of the values' shares) and the basis, axes one after another."""
    _check(method)
    dim = common_length(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for rows, x, values, axes, keep in _solved(batch, dim, method, trim, support):
                values = values[:, : min(x.shape[1], dim)]
                m = np.full(len(rows), min(components, values.shape[1])) if components else dimensions(values)
                variance = np.where(np.arange(values.shape[1]) < m[:, None], values, 0.0).sum(1)
                last = np.take_along_axis(values, m[:, None] - 1, 1)[:, 0]
                good = (values[:, 0] > 1e-10) & (last > 1e-10)
                condition = np.divide(values[:, 0], last, out=np.zeros(len(rows)), where=good)
                share = values / np.maximum(values.sum(1, keepdims=True), 1e-300)
                entropy = -np.where(share > 0, share * np.log(np.where(share > 0, share, 1.0)), 0.0).sum(1)
                basis = [axes[i, :, : m[i]].T.ravel().tolist() for i in range(len(rows))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(rows)), arrays(values), pa.array(m, pa.int32()), pa.array(variance), pa.array(condition, mask=~good), pa.array(keep.sum(1), pa.int32()), pa.array(np.exp(entropy)), pa.array(basis, pa.list_(pa.float64()))],
                    names=[c.split()[0] for c in _LOCAL.split(", ")],
                )

    return patches(table, k).mapInArrow(work, _LOCAL)


def alignment(table: DataFrame, k: int = 20, components: int = 2, method: str = "none", trim: float = 0.1, support: float = 0.75) -> DataFrame:
    """i, j, w: the sum over patches of the projection off their constant and tangent coordinates."""
    _check(method)
    dim = common_length(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = batch.column("near")
            for rows, x, _, axes, _ in _solved(batch, dim, method, trim, support):
                n = x.shape[1]
                theta = (x - x.mean(1, keepdims=True)) @ axes[:, :, :components]
                g = np.concatenate([np.ones((len(rows), n, 1)), theta], axis=2)
                w = np.eye(n) - g @ np.linalg.pinv(g)
                ids = near.take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), n)
                i, j = np.broadcast_to(ids[:, :, None], w.shape), np.broadcast_to(ids[:, None, :], w.shape)
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(w.ravel())], names=["i", "j", "w"])

    return patches(table, k).mapInArrow(work, "i long, j long, w double").groupBy("i", "j").agg(F.sum("w").alias("w"))


def align_tangents(table: DataFrame, k: int = 20, components: int = 2, method: str = "none", rounds: int = 60, **settings) -> DataFrame:
    """id, vec: the coordinates in which all patches are as nearly linear as they can be. A point that is nobody's neighbour has no place."""
    b = materialize(alignment(table, k, components, method, **settings), "alignment")
    top = b.groupBy("i").agg(F.sum(F.abs("w")).alias("s")).agg(F.max("s")).first()[0]
    if top is None:
        return table.select("id", "vec").limit(0)
    shifted = b.select("i", "j", (-F.col("w")).alias("w")).union(b.select("i").distinct().select("i", F.col("i").alias("j"), F.lit(float(top)).alias("w")))
    _, x = eigen(shifted.groupBy("i", "j").agg(F.sum("w").alias("w")), components + 1, rounds)
    # the first is the constant
    return x.select("id", F.slice("x", 2, components).alias("vec"))
