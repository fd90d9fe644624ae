"""Synthetic manifolds: rows of any number, each from a hash of its id, so that a seed gives the same rows anywhere.

Every generator gives ``id``, ``vec`` and the coordinates or label that the points
were made from. ``noisy``, ``without_gaps`` and ``rotated`` go on top of any of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sampling import uniform, uniform_of


def normal_of(key: Column, seed: int) -> Column:
    """A standard normal number for each key."""
    return F.sqrt(-2 * F.log(uniform_of(key, seed))) * F.cos(2 * math.pi * uniform_of(key, seed + 1))


def swiss_roll(spark: SparkSession, n: int, height: float = 21.0, seed: int = 42) -> DataFrame:
    """id, vec (x, y, z), t: the angle along the roll."""
    t = 1.5 * math.pi * (1 + 2 * uniform("id", seed))
    rows = spark.range(n).withColumn("t", t)
    return rows.select("id", F.array(F.col("t") * F.cos("t"), height * uniform("id", seed + 1), F.col("t") * F.sin("t")).alias("vec"), "t")


def unrolled_distance(t: Column, y: Column, t2: Column, y2: Column) -> Column:
    """The distance of two points of a Swiss roll along its sheet: by arc length of the spiral, and height."""
    arc = lambda x: (x * F.sqrt(1 + x * x) + F.asinh(x)) / 2
    return F.sqrt(F.pow(arc(t) - arc(t2), 2) + F.pow(y - y2, 2))


def torus(spark: SparkSession, n: int, major: float = 2.0, minor: float = 0.5, seed: int = 42) -> DataFrame:
    """id, vec (x, y, z), a and b: angles around the ring and the tube."""
    rows = spark.range(n).withColumn("a", 2 * math.pi * uniform("id", seed)).withColumn("b", 2 * math.pi * uniform("id", seed + 1))
    ring = major + minor * F.cos("b")
    return rows.select("id", F.array(ring * F.cos("a"), ring * F.sin("a"), minor * F.sin("b")).alias("vec"), "a", "b")


def torus_distance(a: Column, b: Column, a2: Column, b2: Column, major: float = 2.0, minor: float = 0.5) -> Column:
    """By wrapped angles, around the ring and around the tube."""
    wrapped = lambda x, y: F.least(F.abs(x - y), 2 * math.pi - F.abs(x - y))
    return F.sqrt(F.pow(major * wrapped(a, a2), 2) + F.pow(minor * wrapped(b, b2), 2))


def saddle(spark: SparkSession, n: int, a: float = 1.0, b: float = 1.0, seed: int = 42) -> DataFrame:
    """id, vec (u, v, a u^2 - b v^2), u and v in -1..1."""
    rows = spark.range(n).withColumn("u", 2 * uniform("id", seed) - 1).withColumn("v", 2 * uniform("id", seed + 1) - 1)
    return rows.select("id", F.array("u", "v", a * F.col("u") * F.col("u") - b * F.col("v") * F.col("v")).alias("vec"), "u", "v")


def blobs(spark: SparkSession, sizes: list[int], dim: int = 10, spread: float = 1.0, box: float = 10.0, seed: int = 42) -> DataFrame:
    """id, vec, label: normal clusters of given sizes around centres in a box."""
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    label = F.lit(0)
    for end in ends[:-1]:
        label = label + (F.col("id") >= end).cast("int")
    rows = spark.range(sum(sizes)).withColumn("label", label)

    def coordinate(p: int) -> Column:
        row, centre = F.concat_ws(",", "id", F.lit(p)), F.concat_ws(",", F.lit("c"), "label", F.lit(p))
        return box * (2 * uniform_of(centre, seed) - 1) + spread * normal_of(row, seed)

    return rows.select("id", F.array(*(coordinate(p) for p in range(dim))).alias("vec"), "label")


def archetypal(spark: SparkSession, n: int, components: int = 3, concentration: float = 0.3, radius: float = 1.0, seed: int = 42) -> DataFrame:
    """id, vec, weights: Dirichlet mixtures of the corners of a regular simplex of ``components`` corners in as many dimensions.

    Gamma variables of a shape below one come by the rule of Ahrens and Dieter, unrolled
    to as many tries as make a miss as rare as 2 ** -40; a miss counts as its last try.
    """
    if not 0 < concentration <= 1:
        raise ValueError("concentration must be in (0, 1]")
    e = (math.e + concentration) / math.e

    def gamma(c: int) -> Column:
        out = None
        for attempt in reversed(range(40)):
            key = F.concat_ws(",", "id", F.lit(c), F.lit(attempt))
            p, u = e * uniform_of(key, seed), uniform_of(key, seed + 1)
            small, large = F.pow(p, F.lit(1 / concentration)), -F.log((e - p) / concentration)
            x = F.when(p <= 1, small).otherwise(large)
            good = F.when(p <= 1, u <= F.exp(-small)).otherwise(u <= F.pow(large, F.lit(concentration - 1)))
            out = x if out is None else F.when(good, x).otherwise(out)
        return out

    rows = spark.range(n).select("id", F.array(*(gamma(c) for c in range(components))).alias("g"))
    total = F.aggregate("g", F.lit(0.0), lambda s, x: s + x)
    rows = rows.select("id", F.transform("g", lambda x: x / total).alias("weights"))
    return rows.select("id", F.transform("weights", lambda x: x * radius).alias("vec"), "weights")


def angle(a: Column, b: Column) -> Column:
    """The angle between two vectors, the distance on a sphere."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))))


def tree(spark: SparkSession, branches: list[int], dim: int = 3, step: float = 2.0, noise: float = 0.0, parents: list[int] | None = None, gaps: list[int] | None = None, jump: float = 0.0, seed: int = 42) -> DataFrame:
    """id, vec, branch and step of a branching random walk.

    A branch goes on from a place of its parent (``parents``; the one before it
    by default) that a hash draws, along a direction of its own plus a walk of
    uniform steps: cumulative sums by branch. Branches in ``gaps`` start a jump
    away. Branch ends are few and are added up on the driver, points never are.
    """
    spans, start = [], 0
    for b, n in enumerate(branches):
        spans.append((b, start, n))
        start += n
    sizes = spark.createDataFrame(spans, "branch int, first long, n long")
    rows = sizes.select("branch", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("step")).select((F.col("first") + F.col("step")).alias("id"), "branch", "step")
    move = F.array(*(step * (uniform_of(F.concat_ws(",", "id", F.lit(p)), seed) - 0.5) + uniform_of(F.concat_ws(",", F.lit("way"), "branch", F.lit(p)), seed) - 0.5 for p in range(dim)))
    w = Window.partitionBy("branch").orderBy("step")
    walk = rows.select("id", "branch", "step", move.alias("m")).select("id", "branch", "step", F.array(*(F.sum(F.get("m", F.lit(p))).over(w) for p in range(dim))).alias("vec"))
    rng, parents, gaps = np.random.default_rng(seed), parents or [max(b - 1, 0) for b in range(len(branches))], set(gaps or [])
    joints = [(b, parents[b], int(rng.integers(branches[parents[b]]))) for b in range(1, len(branches))]
    at = {(r.branch, r.step): r.vec for r in walk.join(F.broadcast(spark.createDataFrame([(p, s) for _, p, s in joints] or [(0, 0)], "branch int, step long")), ["branch", "step"]).collect()}
    offsets = {0: np.zeros(dim)}
    for b, parent, s in joints:
        offsets[b] = offsets[parent] + np.array(at[parent, s]) + (jump * rng.normal(size=dim) if b in gaps else 0)
    starts = spark.createDataFrame([(b, v.tolist()) for b, v in offsets.items()], "branch int, start array<double>")
    placed = walk.join(F.broadcast(starts), "branch").select("id", F.zip_with("vec", "start", lambda x, y: x + y).alias("vec"), "branch", "step")
    return noisy(placed, noise, dim, seed + 7) if noise else placed


def tree_from_graph(spark: SparkSession, edges: list[tuple[int, int, int]], hidden: list[tuple[int, int]] | None = None, dim: int = 8, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """id, vec, a, b and share: points along the edges (a, b, points) of a graph whose nodes stand at random places; hidden edges have none."""
    skip = set(hidden or [])
    rng = np.random.default_rng(seed)
    places = {v: rng.normal(size=dim) * 10 for v in sorted({v for a, b, _ in edges for v in (a, b)})}
    spans, first = [], 0
    for a, b, n in edges:
        if (a, b) not in skip:
            spans.append((a, b, first, n, places[a].tolist(), places[b].tolist()))
            first += n
    rows = spark.createDataFrame(spans, "a int, b int, first long, n long, u array<double>, v array<double>")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("at")).withColumn("share", (F.col("at") + 0.5) / F.col("n"))
    out = rows.select((F.col("first") + F.col("at")).alias("id"), F.zip_with("u", "v", lambda x, y: x + (y - x) * F.col("share")).alias("vec"), "a", "b", "share")
    return noisy(out, noise, dim, seed + 7) if noise else out


def cohort(spark: SparkSession, per_class: int = 80, dim: int = 16, layers: tuple[str, ...] = ("rna", "splice", "methyl"), separable: tuple[str, ...] = ("rna", "splice"), shift: float = 4.0, seed: int = 0) -> DataFrame:
    """layer, id, vec and label of two classes, apart by ``shift`` in the separable layers alone."""
    ids = spark.range(2 * per_class).withColumn("label", (F.col("id") >= per_class).cast("int"))
    named = ids.crossJoin(F.broadcast(spark.createDataFrame([(x, x in separable) for x in layers], "layer string, apart boolean")))
    entry = lambda p: normal_of(F.concat_ws(",", "layer", "id", F.lit(p)), seed) + F.when(F.col("apart") & (F.col("label") == 1), shift / math.sqrt(dim)).otherwise(0.0)
    return named.select("layer", "id", F.array(*(entry(p) for p in range(dim))).alias("vec"), "label")


def random_points(spark: SparkSession, n: int = 100, dim: int = 10, seed: int = 42) -> DataFrame:
    """id and vec of standard normal numbers."""
    return spark.range(n).select("id", F.array(*(normal_of(F.concat_ws(",", "id", F.lit(p)), seed) for p in range(dim))).alias("vec"))


def noisy(table: DataFrame, scale: float, dim: int, seed: int = 49) -> DataFrame:
    """The points with normal noise by a hash of id and dimension."""
    e = F.array(*(scale * normal_of(F.concat_ws(",", "id", F.lit(p)), seed) for p in range(dim)))
    return table.withColumn("vec", F.zip_with("vec", e, lambda x, y: x + y))


def without_gaps(table: DataFrame, value: str, gaps: int, share: float = 0.12) -> DataFrame:
    """The points outside of ``gaps`` even intervals of a coordinate that together hold ``share`` of its range."""
    r = table.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    half = share / gaps / 2
    inside = F.lit(False)
    for g in range(gaps):
        inside = inside | (F.abs(at - (g + 1) / (gaps + 1)) < half)
    return table.crossJoin(F.broadcast(r)).where(~inside).select(table.columns)


def rotated(table: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """The points in ``dim`` dimensions, turned by a random orthogonal matrix that keeps all distances."""
    d = table.select(F.size("vec").alias("d")).first()
    if d is None:
        return table
    if dim < d.d:
        raise ValueError("dim is less than the points have")
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0][: d.d]
    entry = lambda c: sum((F.get("vec", F.lit(p)) * float(q[p, c]) for p in range(d.d)), F.lit(0.0))
    return table.withColumn("vec", F.array(*(entry(c) for c in range(dim))))


def ground_truth(table: DataFrame, columns: list[str], distance: Callable[..., Column]) -> DataFrame:
    """i, j, d of all pairs i < j by a distance of their coordinates: for tables that are small by intent."""
    a = table.select(F.col("id").alias("i"), *(F.col(c).alias(f"{c}_1") for c in columns))
    b = table.select(F.col("id").alias("j"), *(F.col(c).alias(f"{c}_2") for c in columns))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", distance(*(F.col(f"{c}_1") for c in columns), *(F.col(f"{c}_2") for c in columns)).alias("d"))


#: Generators by name, in snake case.
DATASETS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (swiss_roll, torus, saddle, blobs, archetypal, tree, tree_from_graph, cohort, random_points)}


def snake(name: str) -> str:
    """``SwissRoll``, ``swissRoll`` and ``swiss-roll`` as ``swiss_roll``."""
    out = ""
    for i, c in enumerate(name.replace("-", "_").replace(" ", "_")):
        out += "_" + c.lower() if c.isupper() and i and not out.endswith("_") else c.lower()
    return out


def get_dataset(spark: SparkSession, name: str, **parameters) -> DataFrame:
    """The points of a generator by its name, however it is written; an unknown name is a KeyError."""
    plain = {k.replace("_", ""): f for k, f in DATASETS.items()}
    wanted = snake(name).replace("_", "")
    if wanted not in plain:
        raise KeyError(f"no dataset {name}; there are {', '.join(list_datasets())}")
    return plain[wanted](spark, **parameters)


def list_datasets() -> list[str]:
    return sorted(DATASETS)
