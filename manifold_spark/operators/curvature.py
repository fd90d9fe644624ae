"""Distances of the rows of a sparse matrix that share a column, in tiles of rows against rows.

Such pairs are far more than the matrix has entries, so none is written or shuffled:
a tile's pairs are made by blocks and only counts and sums leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .neighbours import BLOCK

#: Entries of a tile's rows and of a packed row, about; bins of a count of distances.
ENTRIES, PACK, BINS = 8_000_000, 500_000, 1 << 16


class RowPairs:
    """The rows of a matrix i, j, w (positive, each entry once) packed by side; every pair of sides is a tile."""

    def __init__(self, rows: DataFrame):
        n = rows.count()
        self.sides = max(5, -(-n // ENTRIES))
        chunks = max(1, -(-n // (self.sides * PACK)))
        side = F.pmod(F.xxhash64("i"), F.lit(self.sides)).cast("int").alias("side")
        chunk = F.pmod(F.xxhash64("i", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk")

        def pack(t: pa.Table) -> pa.Table:
            order = np.argsort(t.column("i").to_numpy(), kind="stable")
            return pa.table({"side": t.column("side").slice(0, 1)} | {c: pa.array([t.column(c).to_numpy()[order].tobytes()], pa.binary()) for c in ("i", "j", "w")})

        packed = rows.select("i", "j", F.col("w").cast("double").alias("w"), side, chunk).groupBy("side", "chunk").applyInArrow(pack, "side int, i binary, j binary, w binary")
        self.packed = materialize(packed, "rows")

    def tiles(self, of, schema: str, entries: bool = False) -> DataFrame:
        """``of`` the blocks of each tile, see :func:`_blocks`, gives columns of the schema."""
        every = F.explode(F.sequence(F.lit(0), F.lit(self.sides - 1)))
        x = self.packed.select(F.col("side").alias("a"), every.alias("b"), "i", "j", "w")
        y = self.packed.select(every.alias("a"), F.col("side").alias("b"), "i", "j", "w")
        form = pa.schema([(c.split()[0], {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[c.split()[1]]) for c in schema.split(", ")])

        def work(x: pa.Table, y: pa.Table) -> pa.Table:
            return pa.table(dict(zip(form.names, of(_blocks(_entries(x), _entries(y), entries) if x.num_rows and y.num_rows else iter(())), strict=True)), schema=form)

        deal = lambda t: t.repartition(min(self.sides**2, 1000), "a", "b").groupBy("a", "b")
        return deal(x).cogroup(deal(y)).applyInArrow(work, schema)


def _entries(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j, w = (np.concatenate([np.frombuffer(b, kind) for b in t.column(c).to_pylist()]) for c, kind in (("i", np.int64), ("j", np.int64), ("w", np.float64)))
    order = np.argsort(i, kind="stable")
    return i[order], j[order], w[order]


def _squares(i: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows, where they are first, and their sums of squares: added one by one, so that they are the same in every tile."""
    own, first, at = np.unique(i, return_index=True, return_inverse=True)
    return own, first, np.bincount(at, w * w, len(own))


def _blocks(left, right, entries: bool = False) -> Iterator[tuple]:
    """Of each block of rows of one side: their ids; the row (in the block) and the distance of each pair with a row of the other side that shares a column (or, if ``entries``, that it has an entry at); the row's entry at that other row; and both rows' sums of squares."""
    i, j, w = left
    k, l, v = right
    own, first, square = _squares(i, w)
    first = np.append(first, len(i))
    others, _, theirs = _squares(k, v)
    at = np.searchsorted(others, k)
    # the other side by columns
    order = np.argsort(l, kind="stable")
    columns, begin, size = np.unique(l[order], return_index=True, return_counts=True)
    at, v = at[order], v[order]
    place = np.minimum(np.searchsorted(columns, j), len(columns) - 1)
    meets = np.where(columns[place] == j, size[place], 0)
    target = np.minimum(np.searchsorted(others, j), len(others) - 1)
    is_row = others[target] == j
    work = np.append(0, np.cumsum(meets))[first]
    low = 0
    while low < len(own):
        high = max(low + 1, min(int(np.searchsorted(work, work[low] + BLOCK, "right")) - 1, low + max(1, BLOCK // len(others))))
        part = slice(first[low], first[high])
        row = np.repeat(np.arange(high - low), np.diff(first[low : high + 1]))
        many = meets[part]
        back = np.repeat(begin[place[part]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        sums = np.bincount(np.repeat(row * len(others), many) + at[back], np.repeat(w[part], many) * v[back], (high - low) * len(others))
        entry = np.zeros((high - low) * len(others))
        inside = is_row[part]
        entry[row[inside] * len(others) + target[part][inside]] = w[part][inside]
        pairs = np.flatnonzero((sums > 0) | (entry > 0) if entries else sums)
        r, c = np.divmod(pairs, len(others))
        both = square[low:high][r] + theirs[c]
        apart = both - 2 * sums[pairs]
        # what is left of equal rows is rounding
        yield own[low:high], r, np.sqrt(np.where(apart > 1e-14 * both, apart, 0.0)), entry[pairs], (square[low:high][r], theirs[c])
        low = high


def ball_means(rows: DataFrame, percentile: float) -> DataFrame:
    """i and the mean of its row's entries at the rows k that differ from it by no more than the percentile of the distances of all pairs that share a column.

    Distances are counted in bins; at the second look, only those of the bin that the
    percentile is in are handed on, and the percentile is found among them.
    """
    tiles = RowPairs(rows)
    top = rows.groupBy("i").agg(F.sum(F.col("w") * F.col("w")).alias("s")).agg(F.max("s")).first()[0]
    if top is None:
        return rows.select("i", F.col("w").alias("curvature")).limit(0)
    scale = BINS / (math.sqrt(2 * top) * (1 + 1e-9) or 1.0)

    def count(blocks):
        total = np.zeros(BINS + 1, np.int64)
        for _, _, d, _, _ in blocks:
            total += np.bincount((d * scale).astype(np.int64), minlength=BINS + 1)
        some = np.flatnonzero(total)
        return some, total[some]

    found = tiles.tiles(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).orderBy("b").toArrow()
    bins, below = found.column("b").to_numpy(), np.cumsum(found.column("n").to_numpy())
    want = max(math.ceil(percentile * below[-1]), 1)
    at = int(np.searchsorted(below, want))
    chosen, want = int(bins[at]), want - int(below[at - 1] if at else 0)

    def balls(blocks):
        ids, far, number, mass = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int64)], [np.empty(0)]
        for own, r, d, w, _ in blocks:
            b = (d * scale).astype(np.int64)
            sure, open_ = b < chosen, b == chosen
            ids += [own, own[r[open_]]]
            far += [np.full(len(own), -1.0), d[open_]]
            number += [np.bincount(r[sure], minlength=len(own)), np.ones(open_.sum(), np.int64)]
            mass += [np.bincount(r[sure], w[sure], len(own)), w[open_]]
        return tuple(np.concatenate(c) for c in (ids, far, number, mass))

    inside = materialize(tiles.tiles(balls, "i long, d double, n long, w double"), "balls")
    # a pair's distance from either end can differ in the last bits
    cut = _smallest(inside.where("d >= 0").select("d"), want) + 1e-12 * math.sqrt(2 * top)
    return inside.where(F.col("d") <= cut).groupBy("i").agg(F.try_divide(F.sum("w"), F.sum("n")).alias("curvature")).where("curvature is not null")


def all_ball_means(rows: DataFrame, percentile: float) -> DataFrame:
    """As :func:`ball_means`, with the percentile of the distances of all pairs of rows, each with itself included, and balls that also hold rows that share no column.

    The squared distance of rows that share nothing is the sum of their squares, so those
    pairs need not be made: pairs are counted as if none shared a column, less those that do, plus
    these by their distance. Squared distances are whole multiples of a unit, of 2 ** -50 or so of the
    largest, so that the counts are exact. One number a row is held in one place.
    """
    top = rows.groupBy("i").agg(F.sum(F.col("w") * F.col("w")).alias("s")).agg(F.max("s")).first()[0]
    if top is None:
        return rows.select("i", F.col("w").alias("curvature")).limit(0)
    tiles = RowPairs(rows)
    unit = 2.0 ** (math.floor(math.log2(top)) - 49)
    scale = BINS / (math.sqrt(2 * top / unit) * (1 + 1e-9))
    whole = lambda x: np.rint(x / unit).astype(np.int64)
    place = lambda q: (np.sqrt(q) * scale).astype(np.int64)

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w in zip(b.column("i").to_pylist(), b.column("w").to_pylist(), strict=True):
                own, _, s = _squares(np.frombuffer(i, np.int64), np.frombuffer(w))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(whole(s))], names=["i", "s"])

    squares = materialize(tiles.packed.select("i", "w").mapInArrow(square, "i long, s long"), "squares")
    known = squares.groupBy("s").agg(F.count("*").alias("n")).orderBy("s").toArrow()
    s, many = known.column("s").to_numpy(), known.column("n").to_numpy()
    upto = np.append(0, np.cumsum(many))
    want = max(math.ceil(percentile * int(upto[-1]) ** 2), 1)
    unshared = lambda q: int((many * upto[np.searchsorted(s, q - s, "right")]).sum())

    def edge(b: int) -> int:
        """The largest whole number in bin ``b`` or below."""
        q = int(((b + 1) / scale) ** 2)
        while place(np.float64(q)) > b:
            q -= 1
        while place(np.float64(q + 1)) <= b:
            q += 1
        return q

    def count(blocks):
        total = np.zeros(BINS + 1, np.int64)
        for _, _, d, _, (x, y) in blocks:
            total += np.bincount(place(whole(d * d)), minlength=BINS + 1) - np.bincount(place(whole(x) + whole(y)), minlength=BINS + 1)
        some = np.flatnonzero(total)
        return some, total[some]

    found = tiles.tiles(count, "b long, n long", entries=True).groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    net = np.zeros(BINS + 1, np.int64)
    net[found.column("b").to_numpy()] = found.column("n").to_numpy()
    net = np.cumsum(net)
    chosen = _first(lambda b: int(net[b]) + unshared(edge(b)) >= want, 0, BINS)
    low, high = edge(chosen - 1) if chosen else -1, edge(chosen)
    want -= (int(net[chosen - 1]) if chosen else 0) + unshared(low)
    # a pair's distance from either end can differ in the last bits
    near = lambda q: int((math.sqrt(q) + 1e-12 * math.sqrt(2 * top / unit)) ** 2) + 1
    most = near(high)

    def balls(blocks):
        ids, far, number, mass = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        for own, r, d, w, (x, y) in blocks:
            q, apart = whole(d * d), whole(x) + whole(y)
            sure, open_, less = q <= low, (q > low) & (q <= most), (apart > low) & (apart <= most)
            ids += [own, own[r[open_]], own[r[less]]]
            far += [np.full(len(own), -1), q[open_], apart[less]]
            number += [np.bincount(r[sure], minlength=len(own)) - np.bincount(r[apart <= low], minlength=len(own)), np.ones(open_.sum(), np.int64), np.full(less.sum(), -1)]
            mass += [np.bincount(r[sure], w[sure], len(own)), w[open_], np.zeros(less.sum())]
        return tuple(np.concatenate(c) for c in (ids, far, number, mass))

    inside = materialize(tiles.tiles(balls, "i long, q long, n long, w double", entries=True), "balls")
    base, counted = unshared(low), 0
    left, right = low + 1, high
    while left < right:  # the numbers up to ``left`` - 1 are counted, the cut is not beyond ``right``
        width = -(-(right - left + 1) // 1024)
        bins = inside.where(F.col("q").between(left, right)).groupBy(F.expr(f"(q - {left}) div {width}").alias("b")).agg(F.sum("n").alias("n")).toArrow()
        here = np.zeros(1025, np.int64)
        here[bins.column("b").to_numpy()] = bins.column("n").to_numpy()
        here = counted + np.cumsum(here)
        b = _first(lambda b: int(here[b]) + unshared(min(left + (b + 1) * width - 1, right)) - base >= want, 0, 1023)  # noqa: B023
        counted = int(here[b - 1]) if b else counted
        left, right = left + b * width, min(left + (b + 1) * width - 1, right)
    cut = near(left)
    shared = squares.sparkSession.sparkContext.broadcast((s, upto))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, upto = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(upto[np.searchsorted(s, cut - b.column("s").to_numpy(), "right")])], names=["i", "n"])

    every = squares.mapInArrow(held, "i long, n long").select("i", "n", F.lit(0.0).alias("w"))
    both = inside.where(F.col("q") <= cut).select("i", "n", "w").union(every)
    return both.groupBy("i").agg(F.try_divide(F.sum("w"), F.sum("n")).alias("curvature")).where("curvature is not null")


def _first(true, low: int, high: int) -> int:
    """The first number from ``low`` on for which a rising condition holds, at most ``high``."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if true(middle) else (middle + 1, high)
    return low


def _smallest(values: DataFrame, want: int, bins: int = 1024) -> float:
    """The ``want``-th smallest d, by counts of narrower and narrower ranges."""
    while True:
        low, high = values.agg(F.min("d"), F.max("d")).first()
        if low == high:
            return low
        place = F.least(F.floor((F.col("d") - low) / F.lit(high - low) * bins), F.lit(bins - 1))
        for r in sorted(values.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()):
            if want <= r["n"]:
                values = values.where(F.col("d").between(r["low"], r["high"]))
                break
            want -= r["n"]
