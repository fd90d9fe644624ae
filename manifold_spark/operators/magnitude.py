"""Magnitude of point clouds and the dimension that its growth shows.

The magnitude at a scale t is the sum of the weights w with sum over j of
exp(-t d(i, j)) w(j) = 1 for every point i. The systems of several scales are solved
together by conjugate gradients: a round multiplies all directions with all
kernels tile by tile. Every two tiles meet once, and their distances are taken once for all scales;
a scale that is solved takes no more part. The points of two tiles are written where they meet, so that a round
moves directions and sums only, and is one job. Kernels are never written. A round's work is
quadratic in the points, as the metric is defined on all of them.

Equal points count once (a kernel with equal rows has no solution of its own).
Points that are null, empty, of another length than most or hold null or non-finite
entries take no part. An empty table has no rows; a single point has magnitude 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, scratch_path
from .lanczos import Bucketed, _packed, _unpacked
from .neighbours import _matrix, cells, common_length, nearest_of, same_length, squares, tile_size

#: Tiles of a table, about, until a tile is at its largest; of a small one fewer.
SIDES = 12


def _kernels(d: np.ndarray, scales: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The place and kernel of each scale; of scales that are multiples of the least one, kernels are its powers."""
    times = np.rint(scales / scales.min()).astype(int)
    if times.max() > 4 * len(scales) or not np.allclose(times * scales.min(), scales, rtol=1e-14, atol=0):
        yield from ((s, np.exp(-t * d)) for s, t in enumerate(scales))
        return
    one = np.exp(-scales.min() * d)
    k = one.copy()
    for power in range(1, times.max() + 1):
        if power > 1:
            k *= one
        yield from ((int(s), k) for s in np.flatnonzero(times == power))


_STATE = "tile int, p binary, r binary, w binary, q binary, s binary"


class _Tiles:
    """The points in tiles, and every two tiles where they meet."""

    def __init__(self, points: DataFrame, n: int, dim: int, tile: int):
        self.dim, self.sides = dim, -(-n // tile_size(n, dim, tile, SIDES))
        sides = self.sides

        def pack(t: pa.Table) -> pa.Table:
            return pa.table({"tile": t.column("tile").slice(0, 1), "x": _packed([_matrix(t.column("vec"))])})

        side = F.pmod(F.xxhash64("id"), F.lit(sides)).cast("int").alias("tile")
        self.packed = materialize(points.select("vec", side).groupBy("tile").applyInArrow(pack, "tile int, x binary"), "points")
        self.pairs = Bucketed(points.sparkSession, "magnitude", "pair", min(sides * (sides + 1) // 2, 1000))
        self.pairs.append(self.pairs.dealt(self._at_pairs(self.packed, "x")))

    def _at_pairs(self, rows: DataFrame, column: str) -> DataFrame:
        """A row of a tile at every two tiles that it is one of: their number, and whether it is the second."""
        other = rows.select("tile", column, F.explode(F.sequence(F.lit(0), F.lit(self.sides - 1))).alias("other"))
        pair = F.least("tile", "other") * self.sides + F.greatest("tile", "other")
        return other.select(pair.cast("int").alias("pair"), (F.col("tile") > F.col("other")).alias("second"), column)

    def turn(self, state: DataFrame, step: np.ndarray, turn: np.ndarray, scales: np.ndarray, active: np.ndarray) -> DataFrame:
        """The next state: weights and residuals after ``step`` along the last directions, new directions, and their products with the kernels of the scales that are ``active``.

        An array of a tile has a row a scale. Its sums s are, by scale, those of p q, r q, q q, r r, w and p.
        """
        m, dim, sides = len(scales), self.dim, self.sides

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, tile in enumerate(b.column("tile").to_pylist()):
                    p, r, w, q = (np.frombuffer(b.column(c)[i].as_py()).reshape(m, -1) for c in "prwq")
                    r, w = r - step[:, None] * q, w + step[:, None] * p
                    yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), *(_packed([v]) for v in (r + turn[:, None] * p, r, w))], names=["tile", "p", "r", "w"])

        def multiply(key, points: pa.Table, directions: pa.Table) -> pa.Table:
            a, b = divmod(key[0].as_py(), sides)
            x, p = ({second: v for second, v in zip(t.column("second").to_pylist(), _unpacked(t, c), strict=True)} for t, c in ((points, "x"), (directions, "p")))
            if not x or (a != b and len(x) < 2):
                return pa.table({"tile": pa.array([], pa.int32()), "q": pa.array([], pa.binary())})
            same = a == b
            u, v = x[False].reshape(-1, dim), x[not same].reshape(-1, dim)
            pu, pv = p[False].reshape(m, -1), p[not same].reshape(m, -1)
            qu, qv = np.zeros_like(pu), np.zeros_like(pv)
            for rows, cols in cells(len(u), len(v)):
                d = np.sqrt(squares(u[rows], v[cols]))
                for s, k in _kernels(d, scales[active]):
                    s = active[s]
                    qu[s, rows] += k @ pv[s, cols]
                    if not same:
                        qv[s, cols] += pu[s, rows] @ k
            found = [(a, qu)] if same else [(a, qu), (b, qv)]
            return pa.table({"tile": pa.array([t for t, _ in found], pa.int32()), "q": _packed([q for _, q in found])})

        def add(now: pa.Table, parts: pa.Table) -> pa.Table:
            p, r, w = (_unpacked(now, c)[0].reshape(m, -1) for c in "prw")
            q = np.sum(_unpacked(parts, "q"), axis=0).reshape(m, -1)
            sums = np.stack([(p * q).sum(1), (r * q).sum(1), (q * q).sum(1), (r * r).sum(1), w.sum(1), p.sum(1)])
            return now.append_column("q", _packed([q])).append_column("s", _packed([sums]))

        now = state.mapInArrow(move, "tile int, p binary, r binary, w binary")
        products = self.pairs.read().groupBy("pair").cogroup(self._at_pairs(now, "p").groupBy("pair")).applyInArrow(multiply, "tile int, q binary")
        return now.groupBy("tile").cogroup(products.groupBy("tile")).applyInArrow(add, _STATE)


def magnitudes(table: DataFrame, scales: list[float], rounds: int = 200, tolerance: float = 1e-8, tile: int = 1024) -> DataFrame:
    """scale and magnitude of each scale above 0; stops when all residuals are under ``tolerance`` of the start, or after ``rounds``."""
    spark, t = table.sparkSession, np.array(scales, dtype=float)
    schema = "scale double, magnitude double"
    if (t <= 0).any():
        raise ValueError("scales must be above 0")
    dim = common_length(table)
    points = same_length(table, dim).groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")
    points = materialize(points, "points")
    n, m = points.count(), len(t)
    if not n or not m:
        return spark.createDataFrame([], schema)
    tiles = _Tiles(points, n, dim, tile)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tile, x in zip(b.column("tile").to_pylist(), b.column("x").to_pylist(), strict=True):
                one = np.ones((m, len(x) // (8 * dim)))
                yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), *(_packed([v]) for v in (one, one, 0 * one, 0 * one, np.empty(0)))], names=["tile", "p", "r", "w", "q", "s"])

    state, path = tiles.packed.mapInArrow(begin, _STATE), None
    step, turn, total, active = np.zeros(m), np.zeros(m), np.zeros(m), np.arange(m)
    for _ in range(rounds):
        last, path = path, scratch_path(spark, "state")
        tiles.turn(state, step, turn, t, active).write.parquet(path)
        state = spark.read.schema(_STATE).parquet(path)
        if last:
            discard(spark, last)
        pq, rq, qq, rr, w, p = np.sum([np.frombuffer(r["s"]).reshape(6, m) for r in state.select("s").collect()], axis=0)  # a row a tile
        going = np.isin(np.arange(m), active) & (pq > 0)
        step = np.divide(rr, pq, out=np.zeros(m), where=going)
        new = np.maximum(rr - 2 * step * rq + step * step * qq, 0)
        turn = np.divide(new, rr, out=np.zeros(m), where=going & (rr > 0))
        total = w + step * p
        active = np.flatnonzero(going & (np.sqrt(new / n) > tolerance))
        if not len(active):
            break
    tiles.pairs.drop()
    if path:
        discard(spark, path)
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, total, strict=True)], schema)


def convergence_scale(table: DataFrame, share: float = 0.95, **settings) -> float:
    """About the scale at which the magnitude is ``share`` of the points, between scales of a geometric grid about the nearest distances."""
    points = same_length(table).groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")
    near = nearest_of(points, points, 1, same=True).agg(F.avg("d").alias("d"), F.count("*").alias("n")).first()
    if not near["n"]:
        return 1.0
    grid = np.geomspace(0.25, 16, 7) / near["d"]
    got = np.array([r["magnitude"] for r in magnitudes(points, list(grid), **settings).orderBy("scale").collect()]) / near["n"]
    above = int(np.argmax(got >= share)) if (got >= share).any() else len(grid) - 1
    if above == 0 or got[above] <= got[above - 1]:
        return float(grid[above])
    part = np.clip((share - got[above - 1]) / (got[above] - got[above - 1]), 0, 1)
    return float(grid[above - 1] * (grid[above] / grid[above - 1]) ** part)


def profile(found: DataFrame) -> DataFrame:
    """scale, magnitude and dimension: the slope of log magnitude over log scale from the scale before (null for the first)."""
    rows = sorted((r["scale"], r["magnitude"]) for r in found.collect())  # a row a scale
    out = [(*b, float(np.log(b[1] / a[1]) / np.log(b[0] / a[0])) if a and a[1] > 0 < b[1] else None) for a, b in zip([None, *rows], rows)]  # noqa: B905
    return found.sparkSession.createDataFrame(out, "scale double, magnitude double, dimension double")


def magnitude_dimension(table: DataFrame, n_scales: int = 20, share: float = 0.95, **settings) -> DataFrame:
    """One row: the largest dimension of the profile over ``n_scales`` even scales up to the one of convergence; null with fewer than two points."""
    top = convergence_scale(table, share, **settings)
    found = magnitudes(table, list(np.linspace(0, top, n_scales + 1)[1:]), **settings)
    return profile(found).agg(F.max("dimension").alias("magnitude_dimension"))
