"""Layouts of the fuzzy neighbour graph.

Each point's bandwidth makes its weights sum to log2(k), found by bisection over
its own neighbours; both directions are joined as a + b - a b. The layout starts
from the principal components and moves in synchronous rounds: an edge pulls both
ends together, and each point is pushed off a few others that a hash of point,
round and number draws. A round is a join of the edge table and the draws with the
places and a sum by point, so its cost grows with edges, whatever the number of
points; places are written every round. Every round is a function of the last and of
hashes, so a seed gives the same layout anywhere, but for the order of sums.

Points that take no part in the neighbour graph aren't placed. A point without
neighbours stays where it starts. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .neighbours import knn, same_length


def bandwidths(d: np.ndarray, k: int, rounds: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of distances (nearest first, padded with inf) the least positive one and the bandwidth."""
    known = np.isfinite(d)
    rho = np.where(known & (d > 0), d, np.inf).min(axis=1)
    rho = np.where(np.isfinite(rho), rho, 0.0)
    excess = np.where(known, np.maximum(d - rho[:, None], 0.0), np.inf)
    low, high, mid, target = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d)), np.log2(k)
    for _ in range(rounds):
        over = np.exp(-excess / mid[:, None]).sum(axis=1) > target
        high, low = np.where(over, mid, high), np.where(over, low, mid)
        mid = np.where(np.isinf(high), mid * 2, (low + high) / 2)
    mean = np.where(known, d, 0.0).sum(axis=1) / np.maximum(known.sum(axis=1), 1)
    return rho, np.maximum(mid, 1e-3 * np.maximum(mean, 1e-300))


def fuzzy_graph(table: DataFrame, k: int = 15) -> DataFrame:
    """i, j, w: the fuzzy union of all points' neighbour weights, both directions."""
    near = knn(table, k).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("e"))
    near = near.select("i", F.transform("e", lambda x: x["j"]).alias("j"), F.transform("e", lambda x: x["d"]).alias("d"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column("d").value_lengths().to_numpy()
            flat = b.column("d").flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            d = np.full((len(size), size.max()), np.inf)
            d[row, place] = flat
            rho, sigma = bandwidths(d, k)
            w = np.exp(-np.maximum(flat - rho[row], 0.0) / sigma[row])
            yield pa.RecordBatch.from_arrays([b.column("i").take(pa.array(row)), b.column("j").flatten(), pa.array(w)], names=["i", "j", "w"])

    one = materialize(near.mapInArrow(weigh, "i long, j long, w double"), "memberships")
    both = one.select("i", "j", F.col("w").alias("a"), F.lit(0.0).alias("b")).union(one.select("j", "i", F.lit(0.0), "w"))
    sums = both.groupBy("i", "j").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return sums.select("i", "j", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("w"))


def curve(least: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a x ** 2b) nearest to 1 up to ``least`` and exp(-(x - least) / spread) beyond (least squares)."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x <= least, 1.0, np.exp(-(x - least) / spread))
    p, damp = np.array([1.5, 0.9]), 1e-3
    error = lambda p: 1 / (1 + p[0] * x ** (2 * p[1])) - y
    r = error(p)
    for _ in range(200):
        power = x ** (2 * p[1])
        f = (1 + p[0] * power) ** -2
        jac = np.stack([-f * power, -f * p[0] * power * 2 * np.log(x)], axis=1)
        normal = jac.T @ jac
        step = np.linalg.solve(normal + damp * np.diag(np.diag(normal)), -jac.T @ r)
        new = np.maximum(p + step, 1e-3)
        after = error(new)
        if after @ after < r @ r:
            p, r, damp = new, after, damp / 3
            if np.abs(step).max() < 1e-10:
                break
        else:
            damp *= 4
    return float(p[0]), float(p[1])


def numbered(table: DataFrame) -> tuple[DataFrame, int]:
    """A written table with a number from 0 for each row, without ordering rows in one task; and their count."""
    rows = materialize(table.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id() % (1 << 33)), "placed")
    sizes = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, n = {}, 0
    for part, size in sizes:
        starts[part], n = n, n + size
    # a row for each part of a table
    offset = table.sparkSession.createDataFrame(list(starts.items()), "part int, start long")
    out = rows.join(F.broadcast(offset), "part").withColumn("number", F.col("start") + F.col("place")).drop("part", "place", "start")
    return materialize(out, "numbered"), n


def layout(edges: DataFrame, start: DataFrame, rounds: int = 50, negatives: int = 5, least: float = 0.1, spread: float = 1.0, rate: float = 1.0, seed: int = 42) -> DataFrame:
    """id, vec: the places after ``rounds``; ``start`` has id and vec, ``edges`` both directions of each edge."""
    a, b = curve(least, spread)
    places, n = numbered(start.select("id", "vec"))
    if n < 2:
        return places.select("id", "vec")
    k = places.select(F.size("vec").alias("k")).first()["k"]
    e = materialize(edges.select("i", "j", (F.col("w") / F.lit(edges.agg(F.max("w")).first()[0] or 1.0)).alias("w")), "edges")
    for step in range(rounds):
        alpha = rate * (1 - step / rounds)
        own = places.select(F.col("id").alias("i"), F.col("vec").alias("x"))
        other = places.select(F.col("id").alias("j"), F.col("vec").alias("y"))
        square = F.aggregate(F.zip_with("x", "y", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, c: s + c)
        clipped = lambda f: F.array(*(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), f * (F.get("x", F.lit(c)) - F.get("y", F.lit(c))))) for c in range(k)))
        pairs = e.join(own, "i").join(other, "j").withColumn("s", square).where("s > 0")
        pull = F.lit(-2 * a * b) * F.pow("s", F.lit(b - 1)) / (1 + F.lit(a) * F.pow("s", F.lit(b))) * F.col("w")
        pulls = pairs.select("i", clipped(pull).alias("g"))
        draw = F.pmod(F.xxhash64("id", "draw", F.lit(step), F.lit(seed)), F.lit(n))
        drawn = places.select(F.col("id"), F.col("vec").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(negatives - 1))).alias("draw")).withColumn("number", draw)
        met = drawn.join(places.select("number", F.col("id").alias("j"), F.col("vec").alias("y")), "number").where("id <> j").withColumn("s", square)
        push = F.lit(2 * b) / ((F.lit(0.001) + F.col("s")) * (1 + F.lit(a) * F.pow("s", F.lit(b))))
        pushes = met.select(F.col("id").alias("i"), clipped(push).alias("g"))
        sums = pulls.union(pushes).groupBy(F.col("i").alias("id")).agg(F.array(*(F.sum(F.get("g", F.lit(c))) for c in range(k))).alias("g"))
        moved = places.join(sums, "id", "left").select("id", F.coalesce(F.zip_with("vec", "g", lambda v, g: v + F.greatest(F.lit(-4.0), F.least(F.lit(4.0), g)) * alpha), "vec").alias("vec"), "number")
        places = materialize(moved, "places")
    return places.select("id", "vec")


def embed(table: DataFrame, k: int = 2, neighbours: int = 15, rounds: int = 50, least: float = 0.1, spread: float = 1.0, negatives: int = 5, seed: int = 42) -> DataFrame:
    """id, vec: a layout of all points, from their principal components scaled to ten."""
    from .models import fit_pca

    points = same_length(table)
    model = fit_pca(points, k)
    if model is None:
        return table.select("id", "vec").limit(0)
    start = model.transform(points)
    widest = start.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 1.0
    # a component that isn't there starts by a hash
    from .sampling import uniform

    start = start.select("id", F.array(*(F.coalesce(F.get("vec", F.lit(c)) * F.lit(10.0 / widest), F.lit(0.0)) + F.lit(1e-4) * (uniform("id", seed + c) - 0.5) for c in range(k))).alias("vec"))
    return layout(materialize(fuzzy_graph(points, neighbours), "fuzzy-graph"), start, rounds, negatives, least, spread, seed=seed)
