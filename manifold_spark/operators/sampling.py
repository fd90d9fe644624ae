"""Samples of exact size, drawn by a hash of the id, so that a seed gives the same rows anywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import packed, unpacked

#: Slices of the hash's range by which large strata are counted before any of their rows is ordered.
SLICES = 4096


def uniform(id_col: str, seed: int) -> Column:
    """A number in (0, 1) for each id."""
    return uniform_of(F.col(id_col).cast("string"), seed)


def uniform_of(key: Column, seed: int) -> Column:
    digest = F.md5(F.concat(key, F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))


def random(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(uniform(id_col, seed), id_col).limit(n)


def weighted(df: DataFrame, id_col: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, chances in proportion to weights (Efraimidis and Spirakis)."""
    return df.where(F.col(weight) > 0).orderBy(-F.log(uniform(id_col, seed)) / F.col(weight), id_col).limit(n)


def _first_of_strata(df: DataFrame, id_col: str, by: str, quota: DataFrame, seed: int) -> DataFrame:
    """The first ``want`` rows of each stratum by the hash of the id; ``quota`` has stratum and want. Null is a stratum too.

    Rows are counted by slices of the hash's range. Slices below the one where
    the quota is met are taken whole, and only that one's rows are ordered, so a
    stratum with a large share of all rows is never ordered in one task.
    """
    rows = df.select(packed(df), F.col(by).alias("g"), F.col(id_col).alias("id"), uniform(id_col, seed).alias("u")).withColumn("slice", F.floor(F.col("u") * SLICES))
    counts = rows.groupBy("g", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("slice")) - F.col("n")
    counts = counts.withColumn("before", before).join(quota, F.col("g").eqNullSafe(F.col("stratum"))).where("before < want")
    cut = counts.groupBy("stratum").agg(F.max(F.struct("slice", (F.col("want") - F.col("before")).alias("need"))).alias("cut"))
    met = rows.join(cut, F.col("g").eqNullSafe(F.col("stratum")))
    order = F.row_number().over(Window.partitionBy("g").orderBy("u", "id"))
    last = met.where("slice = cut.slice").withColumn("place", order).where("place <= cut.need")
    return unpacked(met.where("slice < cut.slice").select("row").union(last.select("row")), df.columns)


def stratified(df: DataFrame, id_col: str, by: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, shares of the strata kept: half-even rounding, what is left over to the largest strata."""
    sizes = df.groupBy(F.col(by).alias("stratum")).agg(F.count("*").alias("size"))
    all_ = Window.partitionBy(F.lit(0))  # over strata, not rows
    sizes = sizes.withColumn("want", F.bround(F.lit(float(n)) * F.col("size") / F.sum("size").over(all_)).cast("long"))
    rest = F.lit(n) - F.sum("want").over(all_)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "stratum"))
    sizes = sizes.withColumn("want", F.col("want") + F.when(place <= F.abs(rest), F.signum(rest)).otherwise(0).cast("long"))
    return _first_of_strata(df, id_col, by, sizes.select("stratum", "want"), seed)


def balanced(df: DataFrame, id_col: str, by: str, seed: int = 42) -> DataFrame:
    """At most the median stratum's size of each stratum."""
    sizes = df.groupBy(F.col(by).alias("stratum")).agg(F.count("*").alias("size"))
    cap = sizes.agg(F.floor(F.percentile("size", F.lit(0.5))).alias("want"))
    return _first_of_strata(df, id_col, by, sizes.select("stratum").crossJoin(F.broadcast(cap)), seed)


def fixed(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    return df.join(ids, id_col, "left_semi")


def importance_weights(edges: DataFrame, alpha: float = 1.0) -> DataFrame:
    """i and its weight: the distance of its farthest neighbour to the power, capped at the 99th percentile."""
    r = edges.groupBy("i").agg(F.max("d").alias("r")).withColumn("w", F.pow("r", F.lit(alpha)))
    cut = r.agg(F.percentile("w", F.lit(0.99)).alias("cap"), F.min(F.when(F.col("w") > 0, F.col("w"))).alias("least"))
    return r.crossJoin(F.broadcast(cut)).select("i", F.greatest(F.least("w", "cap"), "least").alias("weight"))


def sketch(table: DataFrame, cell: float, per_cell: int, seed: int = 42) -> DataFrame:
    """A geometric sketch: at most ``per_cell`` points of each grid cell."""
    grid = F.transform("vec", lambda x: F.floor(x / cell))
    w = Window.partitionBy("cell").orderBy(uniform("id", seed), "id")
    return table.withColumn("cell", grid).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_cell).drop("cell", "place")


def density_spike(table: DataFrame, center: list[float], radius: float, multiplier: int, noise: float = 0.05, seed: int = 42) -> DataFrame:
    """The points and ``multiplier`` - 1 jittered copies of those within ``radius`` of the centre; spike 0 or 1."""
    from .neighbours import distance

    near = table.where(distance("vec", F.array(*(F.lit(float(c)) for c in center))) <= radius)
    copies = near.select("id", "vec", F.explode(F.sequence(F.lit(1), F.lit(multiplier - 1))).alias("copy")) if multiplier > 1 else near.limit(0).select("id", "vec", F.lit(1).alias("copy"))
    if noise:
        # normal numbers by a hash of id, copy and dimension
        u = lambda p, s: uniform_of(F.concat_ws(",", "id", "copy", F.lit(p)), s)
        z = [F.sqrt(-2 * F.log(u(p, seed))) * F.cos(2 * math.pi * u(p, seed + 1)) for p in range(len(center))]
        copies = copies.select("id", F.zip_with("vec", F.array(*z), lambda x, e: x + noise * e).alias("vec"))
    return table.select("id", "vec", F.lit(0).alias("spike")).union(copies.select("id", "vec", F.lit(1).alias("spike")))


def sample_size(total: int, n: int | None = None, fraction: float | None = None) -> int:
    """How many rows a sampler takes: exactly one of ``n`` (at most all) and ``fraction`` is given."""
    if (n is None) == (fraction is None):
        raise ValueError("give either n or fraction")
    return min(n, total) if n is not None else int(total * fraction)


def follow(metadata: DataFrame, sample: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of a table that belong to the sampled ids."""
    return metadata.join(sample.select(id_col), id_col, "left_semi")


def condensed(table: DataFrame, target: int = 10, k: int = 5, decay: float = 40.0, scale: float = 1.025, granularity: float = 0.1, rounds: int = 500, seed: int = 42) -> DataFrame:
    """The points of a balanced sample over the groups of diffusion condensation: the first scale with at most ``target`` groups, else the last of ``rounds``."""
    from .spectral import condensation, decay_edges, row_shares

    _, groups = condensation(table, row_shares(decay_edges(table, k, decay)), scale, granularity, rounds, seed=seed, target=target)
    return balanced(table.join(groups, "id"), "id", "group", seed).drop("group")
