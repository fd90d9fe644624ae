"""Archetypal analysis: points as mixtures of a few corners, corners as mixtures of points.

Rows' mixtures are solved where they stand, by projected gradient on the simplex
with the corners broadcast. What the corners need of all rows are sums of corners x
corners and corners x dimension numbers; a corner then moves towards the point that
lies farthest along its descent (a maximum over all rows), by the best step for
all corners together. So corners stay inside of the points, and nothing of the size
of the points leaves the tasks.

Points that are null, empty, of another length than most or hold null or non-finite
entries take no part. With fewer distinct points than corners there are fewer
corners. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .clustering import farthest_points
from .neighbours import same_length
from .spectral import mapped, matrix, summed


def on_simplex(x: np.ndarray) -> np.ndarray:
    """The nearest rows whose entries are not negative and sum to one."""
    falling = -np.sort(-x, axis=1)
    over = np.cumsum(falling, axis=1) - 1
    place = np.arange(1, x.shape[1] + 1)
    last = (falling - over / place > 0).sum(axis=1)
    return np.maximum(x - (np.take_along_axis(over, last[:, None] - 1, 1) / last[:, None]), 0.0)


def mixtures(x: np.ndarray, corners: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Of each row the mixture of the corners that is nearest to it (accelerated projected gradient)."""
    gram, cross = corners @ corners.T, x @ corners.T
    top = max(float(np.linalg.eigvalsh(gram).max()), 1e-300)
    a = np.full(cross.shape, 1 / len(corners))
    ahead, t = a, 1.0
    for _ in range(rounds):
        new = on_simplex(ahead - (ahead @ gram - cross) / top)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, moved = new + (t - 1) / t2 * (new - a), np.abs(new - a).max(initial=0.0)
        a, t = new, t2
        if moved <= tolerance:
            break
    return a


def fit(table: DataFrame, k: int = 3, rounds: int = 25, tolerance: float = 1e-6, seed: int = 42) -> tuple[np.ndarray, float]:
    """The corners (k x dimension) and the mean squared distance of points to their mixtures; from the farthest points on."""
    points = materialize(same_length(table), "points")
    chosen = farthest_points(points, k, seed).orderBy("place").collect()
    if not chosen:
        return np.empty((0, 0)), 0.0
    corners = np.unique(np.array([r["vec"] for r in chosen], dtype=float), axis=0)
    k, d = corners.shape
    n, last, loss = points.count(), np.inf, 0.0
    for _ in range(rounds):
        now = corners

        def sums(x, now=now):
            a = mixtures(x, now)
            return np.concatenate([(a.T @ a).ravel(), (a.T @ x).ravel(), [((x - a @ now) ** 2).sum()]])

        out = summed(points, ["vec"], k * k + k * d + 1, sums)
        aa, ax, loss = out[: k * k].reshape(k, k), out[k * k : -1].reshape(k, d), float(out[-1]) / n
        if last - loss <= tolerance * max(loss, 1e-300):
            break
        last = loss
        slope = aa @ corners - ax

        def farthest(batches, slope=slope):
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column("vec"))
                    gain = x @ slope.T
                    at = gain.argmin(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(gain[at, np.arange(k)]), b.column("vec").take(pa.array(at))], names=["corner", "gain", "vec"])

        best = points.select("vec").mapInArrow(farthest, "corner int, gain double, vec array<double>").groupBy("corner").agg(F.min_by("vec", F.struct("gain", "vec")).alias("vec")).collect()
        towards = np.array([r["vec"] for r in sorted(best, key=lambda r: r["corner"])]) - corners
        # one corner at a time, as each has a best step of its own
        for c in np.argsort((towards * slope).sum(1)):
            slope_c = (aa @ corners - ax)[c]
            gain, bend = -float(slope_c @ towards[c]), float(aa[c, c] * (towards[c] @ towards[c]))
            if gain > 0 and bend > 0:
                corners = corners.copy()
                corners[c] += min(1.0, gain / bend) * towards[c]
    return corners, loss


def transform(table: DataFrame, corners: np.ndarray) -> DataFrame:
    """id, vec: each point's shares of the corners."""
    if not len(corners):
        return table.select("id", "vec").limit(0)
    return mapped(same_length(table, corners.shape[1]), ["vec"], lambda x: mixtures(x, corners), name="vec")


def analyse(table: DataFrame, k: int = 3, **settings) -> DataFrame:
    """id, vec: the shares of ``k`` fitted corners; see :func:`fit`."""
    return transform(table, fit(table, k, **settings)[0])
