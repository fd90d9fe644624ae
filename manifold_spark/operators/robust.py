"""Robust principal components: a table of vectors as a low-rank and a sparse part.

Both solvers of principal component pursuit (augmented Lagrangian, with a growing
penalty ``ialm`` or a fixed one ``admm``) alternate a shrinkage of singular values
and one of entries. With more points than dimensions the singular values of the
whole table are those of a d x d matrix of sums: of M'M, which one pass over the
rows adds up, and the low-rank part of a row is the row times a d x d matrix. So an
iteration is one pass, and only d x d numbers reach the driver. What a row's parts
are after some iterations follows from the row and those matrices, so a pass replays
the iterations since the last time that rows were written (each ``every``), and a
lost task is repeated from there.

Vectors that are null, empty, of another length than most or hold null or
non-finite entries take no part. A table of zeros has rank 0 and no iterations; an
empty one gives an empty one. The dimension is bounded, as its square is held in tasks and on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .neighbours import common_length, same_length
from .spectral import arrays, mapped, matrix, summed


def shrink(x: np.ndarray, by: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0.0)


@dataclass
class Step:
    """One iteration: the matrix that shrinks singular values, the penalty, and what the multipliers are scaled by afterwards."""

    low: np.ndarray
    penalty: float
    scale: float = 1.0


@dataclass
class Parts:
    """``table``: id, low, sparse (arrays). ``rank`` and singular ``values`` of the low-rank part; ``errors``, ``ranks`` and ``sparsity`` by iteration."""

    table: DataFrame
    rank: int
    values: np.ndarray
    errors: list[float] = field(default_factory=list)
    ranks: list[int] = field(default_factory=list)
    sparsity: list[float] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return len(self.errors)


def replay(x: np.ndarray, s: np.ndarray, y: np.ndarray, steps: list[Step], weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The low-rank and sparse parts and the multipliers of some rows after more iterations."""
    low = x - s
    for step in steps:
        pulled = y / step.penalty
        low = (x - s + pulled) @ step.low
        s = shrink(x - low + pulled, weight / step.penalty)
        y = (y + step.penalty * (x - low - s)) * step.scale
    return low, s, y


def threshold(gram: np.ndarray, by: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix M by its M'M: what M is multiplied with so that ``by`` is taken from its singular values, and those that stay."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    sigma = np.sqrt(np.maximum(values, 0.0))
    left = np.maximum(sigma - by, 0.0)
    share = np.divide(left, sigma, out=np.zeros_like(sigma), where=sigma > 0)
    return (vectors * share) @ vectors.T, np.sort(left[left > 0])[::-1]


def decompose(table: DataFrame, solver: str = "ialm", weight: float | None = None, rounds: int | None = None, tolerance: float = 1e-7, delta: float | None = None, penalty: float | None = None, growth: float = 1.5, most: float = 1e7, every: int = 10) -> Parts:
    """The parts of a table.

    ``weight`` of the sparse part is one over the root of the larger side by default.
    With ``delta`` the parts need only fit to a residual of that length (noise).
    """
    if solver not in ("ialm", "admm"):
        raise ValueError(f"no solver {solver}; there are ialm and admm")
    d = common_length(table)
    points = materialize(same_length(table, d), "points")
    n = points.count()
    if not n:
        return Parts(points.select("id", F.col("vec").alias("low"), F.col("vec").alias("sparse")), 0, np.empty(0))
    sums = summed(points, ["vec"], d * d + 1, lambda x: np.append((x.T @ x).ravel(), np.abs(x).sum()))
    gram, size = sums[:-1].reshape(d, d), sums[-1]
    norm = float(np.sqrt(np.trace(gram)))
    if norm == 0:
        return Parts(points.select("id", F.col("vec").alias("low"), F.col("vec").alias("sparse")), 0, np.empty(0))
    weight = weight if weight is not None else 1 / np.sqrt(max(n, d))
    if solver == "ialm":
        widest = points.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda t, c: t + F.abs(c)))).first()[0]
        start = 1 / max(float(np.sqrt(max(np.linalg.eigvalsh(gram).max(), 0))), widest / weight)
        mu, growth, rounds = penalty or 1e-5, growth, rounds or 100
    else:
        start, mu, growth, rounds = 0.0, penalty or n * d / (4 * size), 1.0, rounds or 500
    state = mapped(points, ["vec"], lambda x: np.hstack([x, np.zeros_like(x), start * x]), name="state")
    steps: list[Step] = []
    out = Parts(points, 0, np.empty(0))
    # the first matrix that is shrunk: the rows and their scaled multipliers
    gram = gram * (1 + start / mu) ** 2
    for step in range(rounds):
        low, values = threshold(gram, 1 / mu)
        steps.append(Step(low, mu))
        nxt = min(growth * mu, most) if solver == "ialm" else mu
        done, at = list(steps), nxt

        def sums_of(z, done=done, at=at):
            x, s, y = np.split(z, 3, axis=1)
            low, s, y = replay(x, s, y, done, weight)
            # of the next matrix x - s + y / at, in case that y is scaled as well
            u = x - s
            r = x - low - s
            return np.concatenate([(u.T @ u).ravel(), (u.T @ y).ravel(), (y.T @ y).ravel(), [(r * r).sum(), np.count_nonzero(s)]])

        sums = summed(state, ["state"], 3 * d * d + 2, sums_of)
        uu, uy, yy = (sums[i * d * d : (i + 1) * d * d].reshape(d, d) for i in range(3))
        residual = float(np.sqrt(sums[-2]))
        out.errors.append(residual / norm)
        out.ranks.append(len(values))
        out.sparsity.append(float(sums[-1]) / (n * d))
        out.rank, out.values = len(values), values
        if residual <= delta if delta is not None else residual / norm < tolerance:
            break
        if delta is not None:
            steps[-1].scale = delta / max(residual, delta)
        c = steps[-1].scale / nxt
        gram = uu + c * (uy + uy.T) + c * c * yy
        mu = nxt
        if len(steps) == every and step < rounds - 1:
            finished = list(steps)

            def write(z, finished=finished):
                x, s, y = np.split(z, 3, axis=1)
                _, s, y = replay(x, s, y, finished, weight)
                return np.hstack([x, s, y])

            state, steps = materialize(mapped(state, ["state"], write, name="state"), "parts"), []
    last = list(steps)

    def split(batches):
        for b in batches:
            if b.num_rows:
                low, s, _ = replay(*np.split(matrix(b.column("state")), 3, axis=1), last, weight)
                yield pa.RecordBatch.from_arrays([b.column("id"), arrays(low), arrays(s)], names=["id", "low", "sparse"])

    out.table = materialize(state.mapInArrow(split, "id long, low array<double>, sparse array<double>"), "low-rank")
    return out


def robust_pca(table: DataFrame, k: int = 2, **settings) -> DataFrame:
    """id, vec: the first ``k`` principal components of the low-rank part; of each axis the largest entry is positive."""
    low = decompose(table, **settings).table.select("id", F.col("low").alias("vec"))
    return centred_components(low, k)


def centred_components(table: DataFrame, k: int) -> DataFrame:
    from .models import fit_pca

    model = fit_pca(table, k)
    return table.select("id", "vec").limit(0) if model is None else model.transform(table)
