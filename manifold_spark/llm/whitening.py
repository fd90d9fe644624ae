"""Whitening of embeddings by a randomised range finder.

Vectors become whole numbers, ``floor(scale * c)``, so equal vectors are equal for
certain and sums are exact. The fit list is each distinct vector once. A random
block of ``k + extra`` directions is multiplied by the covariance in ``passes``
power passes over all centred rows of the fit list, with new orthonormal columns
after each; the Rayleigh-Ritz step of the last product gives values and vectors.
The residuals are held against the gaps between values, so they bound the error
of every direction; if they are too large the block becomes the whole space, and
one more pass gives all components to double precision.

A pass is one map over the fit list. A task sums its own rows into numbers of the
size of the block (dimension x block), Spark adds those by place, and only they
reach the driver, whatever the number of rows. Rows are whitened where they stand.

Nulls: a vector that is null or empty or holds null or non-finite entries takes no
part and has no rows in the result, and neither has one of another length than
most (of equally common lengths the longest counts). A null vec_id is kept. Rows
that repeat are whitened each; they count once in the fit list. A scaled entry
that isn't below 2 ** 53 in size is an error, as are sums of squares that fit no
long. Directions whose value is zero but for rounding can't be scaled to one and
have no rows: constant dimensions, fewer distinct vectors than components, a single
vector. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small_batches


@dataclass
class Whitening:
    """``sums`` / ``n`` is the centre; ``vectors`` (dimension x components) and ``values`` by falling value."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ (self.vectors / np.sqrt(self.values))


def whole(vectors: DataFrame, scale: float = 256.0) -> tuple[DataFrame, int]:
    """vec_id and x, the scaled vectors as longs, of rows that take part; and their dimension."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    top = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = top["d"] if top else 0
    error = F.raise_error(F.lit("a scaled entry isn't below 2 ** 53")).cast("long")
    entry = lambda c: F.when(F.abs(F.lit(scale) * c) < F.lit(float(2**53)), F.floor(F.lit(scale) * c)).otherwise(error)
    return v.where(F.size("v") == dim).select("vec_id", F.transform("v", entry).alias("x")), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(fit: DataFrame, size: int, of) -> np.ndarray:
    """The sum over all rows of ``of(x)``, an array of ``size`` numbers for a batch of rows."""
    dim = of.dim

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(matrix(b.column("x"), dim))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["p", "s"])

    found = fit.select("x").mapInArrow(sums, "p int, s double").groupBy("p").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(size)
    out[found.column("p").to_numpy()] = found.column("s").to_numpy()
    return out


class _Product:
    """Of rows x: the sum of centred x'(x block), and of their squared lengths."""

    def __init__(self, dim: int, centre: np.ndarray, block: np.ndarray):
        self.dim, self.centre, self.block = dim, centre, block

    def __call__(self, x: np.ndarray) -> np.ndarray:
        c = x - self.centre
        return np.append((c.T @ (c @ self.block)).ravel(), (c * c).sum())


class _Identity:
    """Of rows x: the products of their whitened entries, and these entries."""

    def __init__(self, dim: int, model: Whitening):
        self.dim, self.model = dim, model

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w = self.model.whiten(x)
        return np.append((w.T @ w).ravel(), w.sum(axis=0))


def _ritz(block: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Falling Ritz values, their unit vectors and the lengths of their residuals, from V times an orthonormal block."""
    small = block.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, turn = values[order], turn[:, order]
    vectors = block @ turn
    return values, vectors, np.linalg.norm(product @ turn - vectors * values, axis=0)


def _settled(values: np.ndarray, residuals: np.ndarray, k: int, tolerance: float) -> bool:
    """Whether the first ``k`` directions are as exact as doubles allow: residuals small against the nearest other value."""
    if len(values) <= k:
        return False
    gaps = np.abs(values[:k, None] - values[None, :])
    gaps[np.arange(k), np.arange(k)] = np.inf
    return bool((residuals[:k] <= tolerance * gaps.min(axis=1)).all())


def fit(rows: DataFrame, dim: int, k: int = 4, extra: int = 8, passes: int = 4, tolerance: float = 1e-12, seed: int = 13) -> Whitening | None:
    """The whitening of the distinct vectors ``x`` of ``rows``; None where there is none."""
    small_batches(rows.sparkSession, 4096)
    # copies are counted once; tasks drop their own before the shuffle
    distinct = materialize(rows.select("x").distinct(), "distinct-vectors")
    place = distinct.select(F.posexplode("x").alias("p", "c")).groupBy("p").agg(F.sum("c").alias("s"), F.count("*").alias("n")).collect()
    if not place:
        return None
    n, sums = place[0]["n"], [r["s"] for r in sorted(place, key=lambda r: r["p"])]
    centre = np.array([s / n for s in sums])

    def product(block: np.ndarray) -> tuple[np.ndarray, float]:
        out = _summed(distinct, block.size + 1, _Product(dim, centre, block)) / n
        return out[:-1].reshape(block.shape), float(out[-1])

    size = min(dim, k + extra)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, size)))[0] if size < dim else np.eye(dim)
    for _ in range(passes):
        out, trace = product(block)
        values, vectors, residuals = _ritz(block, out)
        if size == dim or _settled(values, residuals, k, tolerance):
            break
        block = np.linalg.qr(out)[0]
    else:
        out, trace = product(np.eye(dim))
        values, vectors, _ = _ritz(np.eye(dim), out)
    rank = int((values > dim * np.finfo(float).eps * max(values[0], 0.0)).sum()) if trace > 0 else 0
    k = min(k, rank)
    vectors = vectors[:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    model = Whitening(n, sums, values[:k], vectors, trace)
    if k:
        out = _summed(distinct, k * k + k, _Identity(dim, model)) / n
        second, mean = out[: k * k].reshape(k, k), out[k * k :]
        model.identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    return model


def transform(rows: DataFrame, dim: int, model: Whitening) -> DataFrame:
    """vec_id, deviation and whitened (an array by component) of each row of ``vec_id, x``."""
    sums, n = np.array(model.sums, dtype=np.int64), model.n
    most = (2**63 - 1) // max(dim, 1)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"), dim)
            if n * float(np.abs(x).max()) + float(np.abs(sums).max()) >= float(most) ** 0.5:
                # too large for longs on the way; whole numbers of any size, then a long or an error
                big = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
                deviation = pa.array(big, pa.int64())
            else:
                deviation = pa.array(((n * x - sums) ** 2).sum(axis=1))
            w = model.whiten(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), deviation, lists], names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(whiten, "vec_id long, deviation long, whitened array<double>")


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def report(vectors: DataFrame, k: int = 4, scale: float = 256.0) -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, dim = whole(vectors, scale)
    model = fit(rows, dim, k) if dim else None
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    each = transform(rows, dim, model).select("vec_id", "deviation", F.posexplode("whitened").alias("p", "whitened"))
    return each.select(
        "vec_id",
        (F.col("p") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("p")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
