"""Multidimensional scaling by landmarks.

A bounded number of landmarks (:data:`LANDMARKS`, drawn by a hash of the id, or
the farthest points) is scaled on the driver: classical scaling of their distances,
then stress majorisation. Every point is placed against them where it stands: by
triangulation from its distances to the landmarks, which is exact for Euclidean
input of the right dimension, and by majorising its own stress with the landmarks
fixed. So a point costs distances to the landmarks and nothing is shuffled, and
points that come later are placed by the same model.

Points are ``id, vec``. Vectors that are null, empty, of another length than the
landmarks' or hold null or non-finite entries aren't placed and are no landmarks.
Points that repeat are placed each. With fewer points than dimensions the
coordinates that hold nothing are 0. An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .neighbours import same_length
from .spectral import mapped, matrix

LANDMARKS = 256
#: All landmarks' distances to each other are held on the driver.
MOST_LANDMARKS = 4096


def distances(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """All distances of two blocks, by differences for few rows of ``y`` at a time, so that equal points are at 0."""
    if metric == "cosine":
        length = lambda v: np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-300)
        return np.clip(1 - (x / length(x)) @ (y / length(y)).T, 0, 2)
    if metric != "euclidean":
        raise ValueError(f"no metric {metric}; there are euclidean and cosine")
    out = np.empty((len(x), len(y)))
    for at in range(0, len(y), 16):
        out[:, at : at + 16] = np.sqrt(((x[:, None, :] - y[None, at : at + 16, :]) ** 2).sum(-1))
    return out


def classical(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of points by their distances, and the values of their axes (0 where nothing is left)."""
    square = d**2
    gram = -0.5 * (square - square.mean(0) - square.mean(1)[:, None] + square.mean())
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    values = np.where(values > 1e-12 * max(values[0], 0) if len(values) else False, values, 0.0)
    turn = np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    out = np.zeros((len(d), k))
    out[:, : len(values)] = vectors * turn * np.sqrt(values)
    return out, np.pad(values, (0, k - len(values)))


def monotone(values: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence (pools of adjacent violators)."""
    pools: list[list[float]] = []
    for v in values.tolist():
        pools.append([v, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b, n = pools.pop()
            a, m = pools.pop()
            pools.append([(a * m + b * n) / (m + n), m + n])
    return np.repeat([p[0] for p in pools], [p[1] for p in pools])


def majorise(d: np.ndarray, start: np.ndarray, rounds: int = 300, tolerance: float = 1e-9, ordinal: bool = False) -> tuple[np.ndarray, float]:
    """Coordinates of least stress (a local minimum) and the stress over the sum of squared distances; ``ordinal`` fits the distances' order only."""
    x, target, last = start.copy(), d, np.inf
    upper = np.triu_indices(len(d), 1)
    order = np.argsort(d[upper], kind="stable")
    total = (d[upper] ** 2).sum()
    stress = 0.0
    for _ in range(rounds):
        now = distances(x, x)
        if ordinal and len(order):
            fitted = np.empty(len(order))
            fitted[order] = monotone(now[upper][order])
            length = np.sqrt((fitted**2).sum())
            target = np.zeros_like(d)
            target[upper] = fitted * (np.sqrt(total) / length if length > 0 else 1.0)
            target = target + target.T
        stress = ((now - target)[upper] ** 2).sum() / total if total > 0 else 0.0
        if last - stress <= tolerance:
            break
        last = stress
        ratio = np.divide(target, now, out=np.zeros_like(now), where=now > 1e-12)
        x = (x * ratio.sum(1, keepdims=True) - ratio @ x) / len(x)
    return x - x.mean(0), float(stress)


@dataclass
class Scaling:
    """Landmarks in both spaces, and what places a point: ``pull`` times the differences of squared distances from ``mean``."""

    ids: list[int]
    vectors: np.ndarray
    places: np.ndarray
    pull: np.ndarray
    shift: np.ndarray
    mean: np.ndarray
    stress: float
    metric: str = "euclidean"
    rounds: int = 0

    def place(self, x: np.ndarray) -> np.ndarray:
        d = distances(x, self.vectors, self.metric)
        y = -0.5 * (d**2 - self.mean) @ self.pull.T + self.shift
        for _ in range(self.rounds):
            now = distances(y, self.places)
            ratio = np.divide(d, now, out=np.zeros_like(d), where=now > 1e-12)
            step = self.places.mean(0) + (y * ratio.sum(1, keepdims=True) - ratio @ self.places) / len(self.places)
            if np.abs(step - y).max() <= 1e-10 * max(np.abs(step).max(), 1e-300):
                return step
            y = step
        return y


def landmarks(table: DataFrame, n: int = LANDMARKS, how: str = "hash", seed: int = 42) -> tuple[list[int], np.ndarray]:
    """Ids and vectors of at most ``n`` points, on the driver."""
    if not 1 <= n <= MOST_LANDMARKS:
        raise ValueError(f"landmarks must be from 1 to {MOST_LANDMARKS}")
    if how == "farthest":
        from .clustering import farthest_points

        rows = farthest_points(table, n, seed).collect()
    elif how == "hash":
        rows = sampling.random(table.select("id", "vec").dropDuplicates(["vec"]), "id", n, seed).collect()
    else:
        raise ValueError(f"no way {how} to choose landmarks; there are hash and farthest")
    return [r["id"] for r in rows], np.array([r["vec"] for r in rows], dtype=float)


def fit(table: DataFrame, k: int = 2, how: str = "metric", n_landmarks: int = LANDMARKS, metric: str = "euclidean", choose: str = "hash", rounds: int = 300, seed: int = 42) -> Scaling | None:
    """A scaling to ``k`` dimensions: ``classic``, ``metric`` (least stress) or ``nonmetric`` (least stress of the order). None without points."""
    if how not in ("classic", "metric", "nonmetric"):
        raise ValueError(f"no scaling {how}; there are classic, metric and nonmetric")
    ids, x = landmarks(same_length(table), n_landmarks, choose, seed)
    if not ids:
        return None
    d = distances(x, x, metric)
    start, values = classical(d, k)
    pull = np.divide(start.T, values[:, None], out=np.zeros((k, len(ids))), where=values[:, None] > 0)
    model = Scaling(ids, x, start, pull, np.zeros(k), (d**2).mean(0), 0.0, metric)
    upper = np.triu_indices(len(d), 1)
    if how == "classic":
        total = (d[upper] ** 2).sum()
        model.stress = float(((distances(start, start) - d)[upper] ** 2).sum() / total) if total > 0 else 0.0
        return model
    model.places, model.stress = majorise(d, start, rounds, ordinal=how == "nonmetric")
    # the triangulated place is where the majorisation of a point begins: turned as the landmarks were
    a, b = start - start.mean(0), model.places - model.places.mean(0)
    u, _, v = np.linalg.svd(a.T @ b)
    turn = u @ v
    model.pull, model.shift = turn.T @ pull, model.places.mean(0) - start.mean(0) @ turn
    model.rounds = rounds if how == "metric" else 0
    return model


def transform(table: DataFrame, model: Scaling) -> DataFrame:
    """id, vec: each point's place."""
    return mapped(same_length(table, model.vectors.shape[1]), ["vec"], model.place, name="vec")


def scale(table: DataFrame, k: int = 2, **settings) -> DataFrame:
    """id, vec: all points scaled to ``k`` dimensions; see :func:`fit`."""
    model = fit(table, k, **settings)
    return table.select("id", "vec").limit(0) if model is None else transform(table, model)


def stress(table: DataFrame, placed: DataFrame, model: Scaling) -> DataFrame:
    """One row: the sum of squared errors of all distances between points and landmarks, over the sum of squares of those distances."""
    both = same_length(table, model.vectors.shape[1]).join(placed.select("id", F.col("vec").alias("y")), "id")

    def errors(batches):
        for b in batches:
            if b.num_rows:
                d, now = distances(matrix(b.column("vec")), model.vectors, model.metric), distances(matrix(b.column("y")), model.places)
                yield pa.RecordBatch.from_arrays([pa.array([float(((d - now) ** 2).sum())]), pa.array([float((d**2).sum())])], names=["e", "d"])

    return both.select("vec", "y").mapInArrow(errors, "e double, d double").agg(F.coalesce(F.try_divide(F.sum("e"), F.sum("d")), F.lit(0.0)).alias("stress"))


