"""Persistent homology of point clouds in dimensions 0 and 1.

The Rips filtration is taken of a stated number of points at most (``most``, drawn
by a hash of the id, as its size is cubic in them); their distances, a matrix of a
bounded size, are broadcast. Edges are a distributed range: a task finds, for its
edges, the first triangle that an edge is in, and drops those pairs that are born
and die at once because the edge is also that triangle's longest (nearly all are).
Edges of the spanning tree kill components and start no loop. What is left,
a small share of the edges, is reduced as coboundaries on the driver, longest edge
first; columns of dropped pairs are made again when they are needed.

Equal distances are ordered by the edges' ends. Points that are null, empty, of
another length than most or hold null or non-finite entries take no part. Points
that repeat make bars of length 0, which aren't returned. An empty table has no bars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .neighbours import same_length
from .scaling import distances

#: The distances of all sampled points are broadcast.
MOST_POINTS = 3000


def ordered(d: np.ndarray) -> np.ndarray:
    """The place of every edge by length, ties by its ends; -1 on the diagonal."""
    n = len(d)
    i, j = np.triu_indices(n, 1)
    rank = np.full((n, n), -1, np.int64)
    order = np.lexsort((j, i, d[i, j]))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rank[i, j] = rank[j, i] = place
    return rank


def coboundary(rank: np.ndarray, i: int, j: int) -> np.ndarray:
    """The triangles of an edge, as sorted numbers: the longest edge's place times n, plus the point opposite."""
    n, own = len(rank), rank[i, j]
    a, b = rank[i], rank[j]
    longest = np.maximum(np.maximum(a, b), own)
    opposite = np.where(longest == own, np.arange(n), np.where(longest == a, j, i))
    keys = longest * n + opposite
    keys[[i, j]] = -1
    keys.sort()
    return keys[2:]


def first_triangle(rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each edge its least triangle, as :func:`coboundary` numbers them; -1 with two points only."""
    n, own = len(rank), rank[i, j][:, None]
    a, b = rank[i], rank[j]
    longest = np.maximum(np.maximum(a, b), own)
    opposite = np.where(longest == own, np.arange(n)[None, :], np.where(longest == a, j[:, None], i[:, None]))
    keys = longest * n + opposite
    at = np.arange(len(i))
    keys[at, i] = keys[at, j] = np.iinfo(np.int64).max
    least = keys.min(axis=1) if n > 2 else np.full(len(i), -1)
    return least


def spanning_tree(d: np.ndarray, rank: np.ndarray) -> list[tuple[int, int]]:
    """The edges of the minimum spanning tree."""
    n, out = len(d), []
    inside = np.zeros(n, bool)
    inside[0] = True
    best, parent = rank[0].copy(), np.zeros(n, np.int64)
    for _ in range(n - 1):
        masked = np.where(inside, np.iinfo(np.int64).max, best)
        v = int(masked.argmin())
        out.append((int(parent[v]), v))
        inside[v] = True
        nearer = rank[v] < best
        best, parent = np.where(nearer & ~inside, rank[v], best), np.where(nearer & ~inside, v, parent)
    return out


def reduce_columns(rank: np.ndarray, edges: list[tuple[int, int]], at: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (place of an edge, place of the longest edge of the triangle that ends its loop) of edges, longest first; ``at`` has the ends of each place."""
    n, columns, out = len(rank), {}, []
    for i, j in edges:
        column = coboundary(rank, i, j)
        while len(column):
            pivot = int(column[0])
            other = columns.get(pivot)
            if other is None:
                # the longest edge of the triangle, if the triangle is its first
                p, q = at[pivot // n]
                if (p, q) == (i, j) or first_triangle(rank, np.array([p]), np.array([q]))[0] != pivot:
                    columns[pivot] = column
                    out.append((int(rank[i, j]), pivot // n))
                    break
                other = coboundary(rank, p, q)
            column = np.setxor1d(column, other, assume_unique=True)
    return out


def bars(table: DataFrame, most: int = 500, seed: int = 0, parts: int = 64) -> DataFrame:
    """dimension, birth and death of every finite bar of positive length."""
    if not 1 <= most <= MOST_POINTS:
        raise ValueError(f"most must be from 1 to {MOST_POINTS}")
    spark = table.sparkSession
    schema = "dimension int, birth double, death double"
    rows = sampling.random(same_length(table), "id", most, seed).orderBy("id").collect()
    n = len(rows)
    if n < 2:
        return spark.createDataFrame([], schema)
    x = np.array([r["vec"] for r in rows], dtype=float)
    d = distances(x, x)
    rank = ordered(d)
    shared = spark.sparkContext.broadcast(rank)

    def unpaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column("id").to_pylist():
                rank = shared.value
                j = np.arange(i + 1, n)
                for cut in range(0, len(j), 256):
                    js = j[cut : cut + 256]
                    own = np.full(len(js), i)
                    first = first_triangle(rank, own, js)
                    keep = js[first // n != rank[i, js]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), i)), pa.array(keep)], names=["i", "j"])

    left = spark.range(0, n - 1, 1, min(parts, n - 1)).mapInArrow(unpaired, "i long, j long").toArrow()
    tree = spanning_tree(d, rank)
    killers = {tuple(sorted(e)) for e in tree}
    edges = [e for e in zip(left.column("i").to_pylist(), left.column("j").to_pylist(), strict=True) if e not in killers]
    edges.sort(key=lambda e: -rank[e])
    i, j = np.triu_indices(n, 1)
    at = np.empty((len(i), 2), np.int64)
    at[rank[i, j]] = np.stack([i, j], axis=1)
    length = d[at[:, 0], at[:, 1]]
    found = [(0, 0.0, float(d[e])) for e in tree if d[e] > 0]
    found += [(1, float(length[b]), float(length[e])) for b, e in reduce_columns(rank, edges, at) if length[e] > length[b]]
    return spark.createDataFrame(found, schema)


def persistent_features(found: DataFrame, dimension: int = 1, threshold: float = 0.1, relative: bool = False) -> DataFrame:
    """One row: n, the bars longer than ``threshold`` (of the longest, if ``relative``), longest and cutoff."""
    of = found.where(F.col("dimension") == dimension).select((F.col("death") - F.col("birth")).alias("length"))
    longest = of.agg(F.coalesce(F.max("length"), F.lit(0.0)).alias("longest"))
    cut = longest.withColumn("cutoff", F.when(F.lit(relative) & (F.col("longest") > 0), threshold * F.col("longest")).otherwise(F.lit(threshold)))
    return cut.join(of, F.col("length") > F.col("cutoff"), "left").groupBy("longest", "cutoff").agg(F.count("length").alias("n")).select("n", "longest", "cutoff")
