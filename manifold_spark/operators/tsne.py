"""Stochastic neighbour layouts in two dimensions, without pairs of points.

Affinities are those of each point's nearest neighbours (three times the
perplexity), with a precision found by bisection, made symmetric. A round of the
descent has two parts. Neighbours attract along the edge table: a join with the
places and a sum by point. What pushes all points apart is a sum over all of them,
and comes from a grid of a bounded size: tasks spread their points' charges to the
nodes around them (cubic interpolation), Spark adds the grids, the driver
convolves one grid with the kernels by Fourier transforms, and tasks read it back at
their points. So a round costs edges and points, never pairs of points.

Points that take no part in the neighbour graph aren't placed. A single point
stays where it starts. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .neighbours import knn, same_length
from .sampling import uniform
from .spectral import arrays, mapped, matrix, summed

#: Intervals of the grid along each axis: one a unit of length between these bounds, and nodes in each.
INTERVALS, NODES = (50, 100), 3


def precisions(square: np.ndarray, perplexity: float, rounds: int = 100) -> np.ndarray:
    """Of each row of squared distances (padded with inf) the precision whose shares have the perplexity."""
    known = np.isfinite(square)
    near = square - np.where(known, square, np.inf).min(axis=1, keepdims=True)
    low, high, beta, target = np.zeros(len(square)), np.full(len(square), np.inf), np.ones(len(square)), np.log(perplexity)
    for _ in range(rounds):
        w = np.where(known, np.exp(-np.where(known, near, 0.0) * beta[:, None]), 0.0)
        total = w.sum(axis=1)
        entropy = np.log(total) + beta * (np.where(known, near, 0.0) * w).sum(axis=1) / total
        wide = entropy > target
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return beta


def affinities(table: DataFrame, perplexity: float = 30.0) -> DataFrame:
    """i, j, p: both directions of each edge; all sum to one."""
    near = knn(table, int(3 * perplexity)).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("e"))
    near = near.select("i", F.transform("e", lambda x: x["j"]).alias("j"), F.transform("e", lambda x: x["d"]).alias("d"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column("d").value_lengths().to_numpy()
            flat = b.column("d").flatten().to_numpy() ** 2
            row = np.repeat(np.arange(len(size)), size)
            square = np.full((len(size), size.max()), np.inf)
            square[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            beta = precisions(square, min(perplexity, max(size.max() - 1, 1)))
            w = np.exp(-(flat - square.min(axis=1)[row]) * beta[row])
            w /= np.bincount(row, weights=w)[row]
            yield pa.RecordBatch.from_arrays([b.column("i").take(pa.array(row)), b.column("j").flatten(), pa.array(w)], names=["i", "j", "p"])

    one = materialize(near.mapInArrow(weigh, "i long, j long, p double"), "affinities")
    total = one.agg(F.sum("p")).first()[0] or 1.0
    return one.union(one.select("j", "i", "p")).groupBy("i", "j").agg((F.sum("p") / F.lit(2 * total)).alias("p"))


class Grid:
    """A square that holds all places, with uniform nodes."""

    def __init__(self, low: np.ndarray, high: np.ndarray, intervals: int | None = None):
        intervals = intervals or int(np.clip(np.ceil((high - low).max()), *INTERVALS))
        centre, half = (low + high) / 2, max(float((high - low).max()), 1e-12) / 2 * (1 + 1e-9)
        self.low, self.step, self.intervals = centre - half, 2 * half / intervals, intervals
        self.size = intervals * NODES

    def around(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes about each place, as flat numbers, and their weights: (n, NODES ** 2) both."""
        at = (y - self.low) / self.step
        box = np.clip(np.floor(at).astype(np.int64), 0, self.intervals - 1)
        u, nodes = at - box, (np.arange(NODES) + 0.5) / NODES
        w = np.ones((*y.shape, NODES))
        for k in range(NODES):
            for m in range(NODES):
                if m != k:
                    w[..., k] *= (u - nodes[m]) / (nodes[k] - nodes[m])
        index = box[..., None] * NODES + np.arange(NODES)
        flat = index[:, 0, :, None] * self.size + index[:, 1, None, :]
        return flat.reshape(len(y), -1), (w[:, 0, :, None] * w[:, 1, None, :]).reshape(len(y), -1)

    def spread(self, y: np.ndarray) -> np.ndarray:
        """The charges 1 and both entries, on the nodes."""
        flat, w = self.around(y)
        return np.stack([np.bincount(flat.ravel(), weights=(w * c[:, None]).ravel(), minlength=self.size**2) for c in (np.ones(len(y)), y[:, 0], y[:, 1])])

    def potentials(self, charges: np.ndarray) -> np.ndarray:
        """At the nodes: the sum of 1 / (1 + d2), and those of the three charges over its square."""
        n, gap = self.size, self.step / NODES
        offset = np.minimum(np.arange(2 * n), 2 * n - np.arange(2 * n)) * gap
        kernel = 1 / (1 + offset[:, None] ** 2 + offset[None, :] ** 2)
        once, twice = np.fft.rfft2(kernel), np.fft.rfft2(kernel**2)
        grids = [np.fft.rfft2(c.reshape(n, n), (2 * n, 2 * n)) for c in charges]
        back = lambda f: np.fft.irfft2(f, (2 * n, 2 * n))[:n, :n].ravel()
        return np.stack([back(grids[0] * once), *(back(g * twice) for g in grids)])

    def read(self, fields: np.ndarray, y: np.ndarray) -> np.ndarray:
        flat, w = self.around(y)
        return (fields[:, flat] * w).sum(axis=2).T


def repulsion(places: DataFrame, intervals: int | None = None) -> DataFrame:
    """id, g: what pushes each point (id, vec) off all others."""
    span = places.agg(*(f(F.get("vec", F.lit(c))).alias(f"{n}{c}") for c in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))), F.count("*").alias("n")).first()
    if not span["n"]:
        return places.select("id", F.col("vec").alias("g"))
    grid = Grid(np.array([span["lo0"], span["lo1"]]), np.array([span["hi0"], span["hi1"]]), intervals)
    charges = summed(places, ["vec"], 3 * grid.size**2, grid.spread).reshape(3, -1)
    fields = grid.potentials(charges)
    # the sum over all pairs of points: node charges times their potential; a point's own share is 1
    total = max(float(charges[0] @ fields[0]) - span["n"], 1e-300)
    held = places.sparkSession.sparkContext.broadcast(fields)

    def push(y: np.ndarray) -> np.ndarray:
        f = grid.read(held.value, y)
        return (y * f[:, 1:2] - f[:, 2:4]) / total

    return mapped(places, ["vec"], push, name="g")


def gradient(edges: DataFrame, places: DataFrame, exaggeration: float = 1.0, intervals: int | None = None) -> DataFrame:
    """id, vec: the gradient of the divergence at each place; ``edges`` as of :func:`affinities`."""
    own, other = places.select(F.col("id").alias("i"), F.col("vec").alias("x")), places.select(F.col("id").alias("j"), F.col("vec").alias("y"))
    square = F.aggregate(F.zip_with("x", "y", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, c: s + c)
    pairs = edges.join(own, "i").join(other, "j").withColumn("w", F.col("p") / (1 + square))
    pull = F.array(*(F.sum(F.col("w") * (F.get("x", F.lit(c)) - F.get("y", F.lit(c)))) for c in (0, 1)))
    pulls = pairs.groupBy(F.col("i").alias("id")).agg(pull.alias("a"))
    both = repulsion(places, intervals).join(pulls, "id", "left")
    return both.select("id", F.coalesce(F.zip_with("a", "g", lambda a, g: F.lit(4.0) * (F.lit(exaggeration) * a - g)), F.transform("g", lambda g: F.lit(-4.0) * g)).alias("vec"))


def embed(table: DataFrame, k: int = 2, perplexity: float = 30.0, rounds: int = 250, rate: float | None = None, exaggeration: float = 12.0, seed: int = 42) -> DataFrame:
    """id, vec: two coordinates after ``rounds``, the first quarter of them with affinities made larger."""
    from .models import fit_pca

    if k != 2:
        raise ValueError("the grid is of two dimensions")
    points = same_length(table)
    model = fit_pca(points, 2)
    if model is None:
        return table.select("id", "vec").limit(0)
    edges, n = materialize(affinities(points, perplexity), "affinities"), points.count()
    start = model.transform(points)
    wide = start.agg(F.stddev_pop(F.get("vec", F.lit(0)))).first()[0] or 1.0
    tiny = F.array(*(F.coalesce(F.get("vec", F.lit(c)), F.lit(0.0)) * F.lit(1e-4 / wide) + F.lit(1e-6) * (uniform("id", seed + c) - 0.5) for c in (0, 1)))
    # the state of a point: its place, the last step and the gains
    state = materialize(start.select("id", tiny.alias("vec"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("past")), "state")
    rate = rate or max(n / exaggeration / 4, 50.0)
    for step in range(rounds if n > 1 else 0):
        early = step < rounds // 4
        both = state.join(gradient(edges, state.select("id", "vec"), exaggeration if early else 1.0).withColumnRenamed("vec", "g"), "id")

        def move(batches: Iterator[pa.RecordBatch], momentum=0.5 if early else 0.8) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    y, past, g = (matrix(b.column(c)) for c in ("vec", "past", "g"))
                    last, gains = past[:, :2], past[:, 2:]
                    gains = np.maximum(np.where((g > 0) != (last > 0), gains + 0.2, gains * 0.8), 0.01)
                    last = momentum * last - rate * gains * g
                    yield pa.RecordBatch.from_arrays([b.column("id"), arrays(y + last), arrays(np.hstack([last, gains]))], names=["id", "vec", "past"])

        state = materialize(both.select("id", "vec", "past", "g").mapInArrow(move, "id long, vec array<double>, past array<double>"), "state")
    return state.select("id", "vec")
