"""Fitted models that place rows which they weren't fitted to, and algorithms by name.

A model is small - means and axes, landmarks, or the fitted points' eigenvectors as
a table - and can be written to a folder and read back. ``fit_fraction`` fits to
the points with the smallest hashes of their ids. :data:`ALGORITHMS` names every
projection and clustering; :func:`run_algorithm` gives id and vec (projections) or
id and label (clusterings).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import scaling
from .neighbours import common_length, kernel, knn, nearest_of, same_length
from .sampling import uniform
from .spectral import eigen, mapped, summed


def fraction(table: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """The points whose hash is below ``share``; all with 1."""
    if not 0 < share <= 1:
        raise ValueError("fit_fraction must be above 0 and at most 1")
    return table if share == 1 else table.where(uniform("id", seed) < share)


@dataclass
class Linear:
    """Rows minus ``mean`` times ``axes`` (dimension x components)."""

    mean: list[float]
    axes: list[list[float]]
    values: list[float]

    def transform(self, table: DataFrame) -> DataFrame:
        mean, axes = np.array(self.mean), np.array(self.axes)
        return mapped(same_length(table, len(mean)), ["vec"], lambda x: (x - mean) @ axes, name="vec")


@dataclass
class Landmarks:
    """A :class:`scaling.Scaling` with lists in place of arrays."""

    parts: dict

    def model(self) -> scaling.Scaling:
        return scaling.Scaling(**{k: np.array(v) if isinstance(v, list) and k != "ids" else v for k, v in self.parts.items()})

    def transform(self, table: DataFrame) -> DataFrame:
        return scaling.transform(table, self.model())


@dataclass
class Diffusion:
    """Diffusion coordinates, extended to new points: a kernel-weighted mean of the eigenvectors of the neighbours among the fitted points, over the eigenvalue."""

    points: str
    values: list[float]
    k: int
    t: int

    def transform(self, table: DataFrame) -> DataFrame:
        """id, vec. A fitted point (by its id and vector) gets the coordinates that it was fitted with."""
        spark = table.sparkSession
        fitted = spark.read.parquet(self.points)
        values = [v if abs(v) > 1e-12 else float("inf") for v in self.values]
        rows = same_length(table, common_length(fitted.select("id", "vec")))
        known = fitted.select("id", F.col("vec").alias("v"), "psi")
        own = rows.join(known, "id", "left").withColumn("psi", F.when(F.col("v") == F.col("vec"), F.col("psi")))
        place = lambda psi, over: F.array(*(F.get(psi, F.lit(c)) * F.lit(float(self.values[c] ** self.t)) / F.lit(over[c]) for c in range(len(values))))
        seen = own.where("psi is not null").select("id", place("psi", [1.0] * len(values)).alias("vec"))
        new = materialize(own.where("psi is null").select("id", "vec"), "new-points")
        e = nearest_of(new, fitted.select("id", "vec"), self.k)
        width = e.groupBy("i").agg(F.greatest(F.max("d"), F.lit(1e-12)).alias("s"))
        near = e.join(width, "i").join(fitted.select(F.col("id").alias("j"), "psi", F.col("width"), "degree"), "j")
        # the kernel and its density normalisation as in the fit, with the new point's own width
        w = F.exp(-F.col("d") * F.col("d") / F.greatest(F.col("s") * F.col("width"), F.lit(1e-20))) / F.col("degree")
        near = near.withColumn("w", w)
        sums = near.groupBy("i").agg(F.sum("w").alias("all"), *(F.sum(F.col("w") * F.get("psi", F.lit(c))).alias(f"p{c}") for c in range(len(values))))
        mean = F.array(*(F.col(f"p{c}") / F.col("all") for c in range(len(values)))).alias("psi")
        return seen.union(sums.select(F.col("i").alias("id"), mean).select("id", place("psi", values).alias("vec")))


def fit_pca(table: DataFrame, k: int = 2, fit_fraction: float = 1.0, seed: int = 42) -> Linear | None:
    """Means and the first ``k`` axes of the largest variance, by sums of d x d numbers; None without points. Of each axis the largest entry is positive."""
    d = common_length(table)
    points = fraction(same_length(table, d), fit_fraction, seed)
    sums = summed(points, ["vec"], d + 1, lambda x: np.append(x.sum(0), len(x)))
    n = sums[-1]
    if not n:
        return None
    mean = sums[:-1] / n
    cov = summed(points, ["vec"], d * d, lambda x: (x - mean).T @ (x - mean)).reshape(d, d) / max(n - 1, 1)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return Linear(mean.tolist(), vectors.tolist(), values.tolist())


def fit_scaling(table: DataFrame, k: int = 2, fit_fraction: float = 1.0, seed: int = 42, **settings) -> Landmarks | None:
    model = scaling.fit(fraction(table, fit_fraction, seed), k, seed=seed, **settings)
    if model is None:
        return None
    return Landmarks({key: v.tolist() if isinstance(v, np.ndarray) else v for key, v in vars(model).items()})


def fit_diffusion(table: DataFrame, k: int = 2, neighbours: int = 15, t: int = 1, fit_fraction: float = 1.0, seed: int = 42) -> Diffusion | None:
    """Coordinates of the neighbour graph's transition matrix (densities divided out), which :meth:`Diffusion.transform` extends."""
    from ..session import scratch_path
    from .spectral import degrees, symmetric_operator

    points = materialize(fraction(same_length(table), fit_fraction, seed), "fitted")
    near = materialize(knn(points, neighbours), "neighbours")
    edges = kernel(near).select("i", "j", "w").where("i <> j").union(points.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("w")))
    edges = materialize(edges, "kernel")
    values, vectors = eigen(symmetric_operator(edges, 1.0), k + 1)
    if not len(values):
        return None
    psi = F.array(*(F.get("x", F.lit(c)) / F.get("x", F.lit(0)) for c in range(1, len(values))))
    width = near.groupBy(F.col("i").alias("id")).agg(F.max("d").alias("width"))
    table_ = points.join(vectors.select("id", psi.alias("psi")), "id").join(width, "id", "left").join(degrees(edges).withColumnRenamed("i", "id"), "id")
    path = scratch_path(table.sparkSession, "diffusion-model")
    table_.select("id", "vec", "psi", F.coalesce("width", F.lit(1.0)).alias("width"), "degree").write.parquet(path)
    return Diffusion(path, [float(v) for v in values[1:]], neighbours, t)


_MODELS = {c.__name__: c for c in (Linear, Landmarks, Diffusion)}


def save(spark: SparkSession, model, path: str) -> None:
    """Write a model to a new folder; its tables are copied there."""
    parts = asdict(model)
    if isinstance(model, Diffusion):
        spark.read.parquet(model.points).write.parquet(f"{path}/points")
        parts["points"] = f"{path}/points"
    spark.createDataFrame([(type(model).__name__, json.dumps(parts))], "kind string, parts string").coalesce(1).write.parquet(f"{path}/model")


def load(spark: SparkSession, path: str):
    row = spark.read.parquet(f"{path}/model").first()
    return _MODELS[row["kind"]](**json.loads(row["parts"]))


@dataclass
class Algorithm:
    run: Callable[..., DataFrame]
    kind: str
    aliases: tuple[str, ...] = ()


def _fitted(fit: Callable) -> Callable[..., DataFrame]:
    def run(table: DataFrame, **settings) -> DataFrame:
        model = fit(table, **settings)
        return table.select("id", "vec").limit(0) if model is None else model.transform(table)

    return run


def _phate(table: DataFrame, **settings) -> DataFrame:
    from .phate import embed

    return embed(table, **settings)


def _umap(table: DataFrame, **settings) -> DataFrame:
    from .umap import embed

    return embed(table, **settings)


def _tsne(table: DataFrame, **settings) -> DataFrame:
    from .tsne import embed

    return embed(table, **settings)


def _robust(table: DataFrame, **settings) -> DataFrame:
    from .robust import robust_pca

    return robust_pca(table, **settings)


def _communities(table: DataFrame, neighbours: int = 15, **settings) -> DataFrame:
    from .clustering import communities

    found = communities(kernel(knn(table, neighbours)), **settings)
    return found.select(F.col("node").alias("id"), F.col("community").alias("label"))


def _kmeans(table: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    from .comparison import kmeans

    return kmeans(same_length(table), k, seed).select("id", F.col("cluster").alias("label"))


def _ltsa(table: DataFrame, k: int = 2, neighbours: int = 20, **settings) -> DataFrame:
    from .local import align_tangents

    return align_tangents(table, neighbours, k, **settings)


def _archetypes(table: DataFrame, **settings) -> DataFrame:
    from .archetypes import analyse

    return analyse(table, **settings)


def _noop(table: DataFrame) -> DataFrame:
    return table.select("id", "vec")


ALGORITHMS = {
    "pca": Algorithm(_fitted(fit_pca), "projection"),
    "robust_pca": Algorithm(_robust, "projection", ("rpca",)),
    "mds": Algorithm(_fitted(fit_scaling), "projection", ("multidimensional_scaling",)),
    "diffusion_map": Algorithm(_fitted(fit_diffusion), "projection", ("diffusionmap",)),
    "phate": Algorithm(_phate, "projection"),
    "umap": Algorithm(_umap, "projection"),
    "tsne": Algorithm(_tsne, "projection", ("t-sne",)),
    "ltsa": Algorithm(_ltsa, "projection", ("local_tangent_space_alignment",)),
    "archetypal_analysis": Algorithm(_archetypes, "projection", ("aa",)),
    "noop": Algorithm(_noop, "projection"),
    "leiden": Algorithm(_communities, "clustering", ("communities",)),
    "kmeans": Algorithm(_kmeans, "clustering"),
}


def list_algorithms(kind: str | None = None) -> list[str]:
    return sorted(name for name, a in ALGORITHMS.items() if kind in (None, a.kind))


def get_algorithm(name: str) -> Algorithm:
    """By name or alias, whatever its case; a KeyError names what there is."""
    wanted = name.lower()
    for key, a in ALGORITHMS.items():
        if wanted == key or wanted in a.aliases:
            return a
    raise KeyError(f"no algorithm {name}; there are {', '.join(list_algorithms())}")


def run_algorithm(table: DataFrame, name: str, **settings) -> DataFrame:
    return get_algorithm(name).run(table, **settings)
