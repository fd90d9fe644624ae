"""Potential-distance embedding with landmarks.

The alpha-decay kernel of the neighbour graph is an edge table. Points are dealt
over landmarks (the nearest of some points, or k-means of spectral coordinates);
the kernel summed by landmark, as shares, gives the steps from landmarks to points
and from points to landmarks. Their product, a join on the point and a sum by both
landmarks, is the diffusion among the landmarks, of a bounded size
(:data:`LANDMARKS` squared), and that alone reaches the driver: there it is
raised to the power t - given, or the knee of its von Neumann entropy -, its
negative logarithms are potentials, and their distances are scaled
to coordinates. Back to the points it goes by a join and a weighted mean. With as
many landmarks as points each point is its own and the operator is the graph's.

Points that take no part in the neighbour graph (null, empty or non-finite vectors,
another length than most) aren't placed. A single point is at the origin.
An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import scaling
from .neighbours import knn, same_length

LANDMARKS = 500


def kernel(table: DataFrame, k: int = 5, decay: float = 40.0, threshold: float = 1e-4, reach: int | None = None) -> DataFrame:
    """i, j, w: exp(-(d / d_k) ** decay), the mean of both directions, one on the diagonal.

    ``d_k`` is the distance to the ``k``-th neighbour. Neighbours to rank ``reach``
    (10 k) are looked at; of them the first ``k`` and those of a weight of
    ``threshold`` or more count.
    """
    # read twice
    e = materialize(knn(table, reach or 10 * k), "neighbours")
    width = e.where(F.col("rank") <= k).groupBy("i").agg(F.greatest(F.max("d"), F.lit(1e-12)).alias("s"))
    w = e.join(width, "i").select("i", "j", "rank", F.exp(-F.pow(F.col("d") / F.col("s"), F.lit(float(decay)))).alias("w"))
    w = w.where((F.col("rank") <= k) | (F.col("w") >= threshold)).select("i", "j", "w")
    both = w.union(w.select("j", "i", "w")).groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))
    points = same_length(table)
    return both.union(points.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("w")))


def assigned(table: DataFrame, n: int, how: str = "nearest", edges: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """id and landmark (a number from 0). ``nearest``: of ``n`` points by hash; ``spectral``: k-means of the graph's leading coordinates."""
    from .comparison import kmeans

    points = same_length(table)
    if points.count() <= n:
        ids = [r["id"] for r in points.select("id").distinct().orderBy("id").collect()]
        return points.select("id").join(F.broadcast(table.sparkSession.createDataFrame(list(enumerate(ids)), "landmark int, id long")), "id").select("id", "landmark")
    if how == "spectral":
        from . import spectral

        _, x = spectral.eigen(spectral.symmetric_operator(edges, 0.0), min(50, n))
        return kmeans(x.select("id", F.col("x").alias("vec")), n, seed).select("id", F.col("cluster").alias("landmark"))
    _, at = scaling.landmarks(points, n, "hash", seed)

    def nearest(batches):
        import pyarrow as pa

        from .spectral import matrix

        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(scaling.distances(matrix(b.column("vec")), at).argmin(1).astype(np.int32))], names=["id", "landmark"])

    return points.mapInArrow(nearest, "id long, landmark int")


def entropy(operator: np.ndarray, most: int = 100) -> np.ndarray:
    """The von Neumann entropy of the powers 1 to ``most`` of an operator."""
    s = np.linalg.svd(operator, compute_uv=False)
    out = []
    for t in range(1, most + 1):
        p = s**t
        p = p[p > 0] / p.sum()
        out.append(float(-(p * np.log(p)).sum()))
    return np.array(out)


def knee(y: np.ndarray) -> int:
    """The place (from 0) that splits a curve into two lines with the least squared error."""
    if len(y) < 4:
        return len(y) - 1
    x, errors = np.arange(len(y), dtype=float), []
    for cut in range(1, len(y) - 1):
        errors.append(sum(np.sum((y[part] - np.polyval(np.polyfit(x[part], y[part], 1), x[part])) ** 2) for part in (slice(0, cut + 1), slice(cut, len(y)))))
    return int(np.argmin(errors)) + 1


def diffusion(edges: DataFrame, landmark: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """i, landmark, p: the step from each point to the landmarks (a written table); and the operator among landmarks."""
    named = landmark.select(F.col("id").alias("j"), "landmark")
    sums = materialize(edges.join(named, "j").groupBy("i", "landmark").agg(F.sum("w").alias("w")), "landmark-kernel")
    out = sums.join(sums.groupBy("i").agg(F.sum("w").alias("all")), "i").select("i", "landmark", (F.col("w") / F.col("all")).alias("p"))
    out = materialize(out, "to-landmarks")
    # one row a landmark
    back = sums.join(F.broadcast(sums.groupBy("landmark").agg(F.sum("w").alias("all"))), "landmark").select("i", F.col("landmark").alias("a"), (F.col("w") / F.col("all")).alias("q"))
    rows = back.join(out, "i").groupBy("a", "landmark").agg(F.sum(F.col("q") * F.col("p")).alias("w")).toArrow()
    n = max(rows.column("a").to_numpy().max(initial=-1), rows.column("landmark").to_numpy().max(initial=-1)) + 1
    operator = np.zeros((n, n))
    operator[rows.column("a").to_numpy(), rows.column("landmark").to_numpy()] = rows.column("w").to_numpy()
    return out, operator


def transition(edges: DataFrame, landmark: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The same where every point is a landmark: the graph's own transition matrix."""
    named = landmark.select(F.col("id").alias("i"), F.col("landmark").alias("a"))
    total = edges.groupBy("i").agg(F.sum("w").alias("all"))
    rows = edges.join(total, "i").join(named, "i").join(landmark.select(F.col("id").alias("j"), "landmark"), "j").select("a", "landmark", (F.col("w") / F.col("all")).alias("p")).toArrow()
    n = max(rows.column("a").to_numpy().max(initial=-1), rows.column("landmark").to_numpy().max(initial=-1)) + 1
    operator = np.zeros((n, n))
    operator[rows.column("a").to_numpy(), rows.column("landmark").to_numpy()] = rows.column("p").to_numpy()
    return landmark.select(F.col("id").alias("i"), "landmark", F.lit(1.0).alias("p")), operator


def potential(operator: np.ndarray, t: int) -> np.ndarray:
    """Distances of the rows' negative logarithms."""
    u = -np.log(np.linalg.matrix_power(operator, t) + 1e-7)
    return scaling.distances(u, u)


def embed(table: DataFrame, k: int = 2, neighbours: int = 5, decay: float = 40.0, t: int | str = "auto", n_landmarks: int = LANDMARKS, how: str = "metric", choose: str = "nearest", seed: int = 42) -> DataFrame:
    """id, vec: coordinates of all points; ``how`` as in :func:`scaling.fit`."""
    if not 1 <= n_landmarks <= scaling.MOST_LANDMARKS:
        raise ValueError(f"landmarks must be from 1 to {scaling.MOST_LANDMARKS}")
    edges = materialize(kernel(table, neighbours, decay), "decay-kernel")
    landmark = materialize(assigned(table, n_landmarks, choose, edges, seed), "landmarks")
    all_own = landmark.agg(F.count("*") == F.count_distinct("landmark")).first()[0]
    steps, operator = (transition if all_own else diffusion)(edges, landmark)
    if not len(operator):
        return table.select("id", "vec").limit(0)
    # landmarks of k-means that no point is nearest to have no row
    used = operator.sum(1) > 0
    small = operator[np.ix_(used, used)]
    d = potential(small, int(knee(entropy(small))) + 1 if t == "auto" else int(t))
    y, _ = scaling.classical(d, k)
    if how != "classic":
        y, _ = scaling.majorise(d, y, ordinal=how == "nonmetric")
    places = table.sparkSession.createDataFrame([(int(a), [float(c) for c in row]) for a, row in zip(np.flatnonzero(used), y, strict=True)], "landmark int, y array<double>")
    mean = F.array(*(F.sum(F.col("p") * F.get("y", F.lit(c))) for c in range(k)))
    return steps.join(F.broadcast(places), "landmark").groupBy(F.col("i").alias("id")).agg(mean.alias("vec"))
