"""Metrics by name: each takes point tables and gives one number; several are evaluated as one long table.

A metric's own name has its plain defaults; an alias may carry presets. Neighbour
tables are searched once for the largest ``k`` that any of the asked metrics
needs, written, and cut by rank for the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import comparison, homology, magnitude, spectral
from ..operators import neighbours as nb
from ..operators import statistics as st
from ..session import materialize
from .runs import unrolled


@dataclass
class Spaces:
    """Two point tables on the same ids, labels (id, label) where there are any, and the neighbour tables found so far."""

    high: DataFrame
    low: DataFrame
    labels: DataFrame | None = None
    found: dict[str, tuple[int, DataFrame]] = field(default_factory=dict)

    def edges(self, side: str, k: int) -> DataFrame:
        if side not in self.found or self.found[side][0] < k:
            self.found[side] = k, materialize(nb.knn(getattr(self, side), k), f"neighbours-{side}")
        return self.found[side][1].where(F.col("rank") <= k)


@dataclass(frozen=True)
class Metric:
    """A metric under one of its names: what computes it, the presets of the name, and the neighbour tables that it reads by the parameter that sizes them."""

    compute: Callable[..., DataFrame]
    presets: dict
    reads: tuple[tuple[str, str], ...]
    per_sample: Callable[..., DataFrame] | None = None

    def parameters(self, given: dict) -> dict:
        return {**self.presets, **given}


METRICS: dict[str, Metric] = {}


def metric(*names: str, aliases: dict[str, dict] | None = None, reads: tuple[tuple[str, str], ...] = (), per_sample: Callable[..., DataFrame] | None = None):
    """Register a function of :class:`Spaces` under names without presets, and aliases with them."""

    def add(f):
        for n in names:
            METRICS[n] = Metric(f, {}, reads, per_sample)
        for n, presets in (aliases or {}).items():
            METRICS[n] = Metric(f, presets, reads, per_sample)
        return f

    return add


def _mean(samples: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The mean of a per-sample metric (id, value)."""
    return lambda s, **p: samples(s, **p).agg(F.avg("value"))


def sampled(*names: str, aliases: dict[str, dict] | None = None, reads: tuple[tuple[str, str], ...] = ()):
    """Register a per-sample metric, whose value is its mean."""

    def add(f):
        metric(*names, aliases=aliases, reads=reads, per_sample=f)(_mean(f))
        return f

    return add


_BOTH, _HIGH, _LOW = (("high", "k"), ("low", "k")), (("high", "k"),), (("low", "k"),)


@sampled("KNNPreservation", aliases={"knn_preservation": {"k": 10}}, reads=_BOTH)
def knn_preservation(s: Spaces, k: int = 10) -> DataFrame:
    return nb.overlap(s.edges("high", k), s.edges("low", k)).select(F.col("i").alias("id"), F.col("overlap").alias("value"))


@sampled("Continuity", aliases={"continuity": {"k": 25}}, reads=_BOTH)
def continuity(s: Spaces, k: int = 25) -> DataFrame:
    return knn_preservation(s, k)


@metric("Trustworthiness", aliases={"trustworthiness": {"k": 25}, "trust": {"k": 25}}, reads=_BOTH)
def trustworthiness(s: Spaces, k: int = 25) -> DataFrame:
    return nb.trustworthiness(s.high, s.edges("low", k), k, s.edges("high", k))


@sampled("CrossModalJaccard", aliases={"cross_modal_jaccard": {"k": 20}, "neighborhood_jaccard": {"k": 20}, "cross_modal_overlap": {"k": 20}}, reads=_BOTH)
def cross_modal_jaccard(s: Spaces, k: int = 20) -> DataFrame:
    return nb.jaccard(s.edges("high", k), s.edges("low", k)).select(F.col("i").alias("id"), F.col("jaccard").alias("value"))


@sampled("AlignmentScore", aliases={"alignment": {"k": 20}, "modal_alignment": {"k": 20}}, reads=_BOTH)
def alignment(s: Spaces, k: int = 20) -> DataFrame:
    return cross_modal_jaccard(s, k)


@sampled("LocalIntrinsicDimensionality", aliases={"lid": {"k": 20}, "local_intrinsic_dim": {"k": 20}, "intrinsic_dim": {"k": 20}}, reads=_LOW)
def lid(s: Spaces, k: int = 20) -> DataFrame:
    """Of the embedding."""
    return nb.intrinsic_dimension(s.edges("low", k)).select(F.col("i").alias("id"), F.col("lid").alias("value"))


@metric("RankAgreement", aliases={"lid_rank_agreement": {"k": 20}, "rank_correlation": {"k": 20}}, reads=_BOTH)
def rank_agreement(s: Spaces, k: int = 20) -> DataFrame:
    a, b = nb.intrinsic_dimension(s.edges("high", k)), nb.intrinsic_dimension(s.edges("low", k))
    return st.spearman(a.join(b.withColumnRenamed("lid", "other"), "i"), "lid", "other")


@sampled("LogLogConsistency", aliases={n: {"k": 200} for n in ("loglog_consistency", "power_law_consistency", "lid_reliability")}, reads=_LOW)
def log_log(s: Spaces, k: int = 200) -> DataFrame:
    return nb.log_log(s.edges("low", k), nb.grid(k)).select(F.col("i").alias("id"), F.col("r2").alias("value"))


@sampled("MismatchRatio", aliases={n: {"k": 200} for n in ("mismatch_ratio", "v_ratio", "mismatch")}, reads=_HIGH)
def mismatch_ratio(s: Spaces, k: int = 200, kernel_k: int = 15) -> DataFrame:
    e = s.edges("high", k)
    ratio = nb.effective_size(nb.kernel(e.where(F.col("rank") <= kernel_k))).join(nb.k_star(e, nb.grid(k)), "i")
    return ratio.select(F.col("i").alias("id"), (F.col("k_eff") / F.col("k_star")).alias("value"))


@sampled("EffectiveNeighborhoodSize", aliases={n: {} for n in ("effective_neighborhood_size", "effective_k", "k_eff")}, reads=_HIGH)
def effective_size(s: Spaces, k: int = 15) -> DataFrame:
    return nb.effective_size(nb.kernel(s.edges("high", k))).select(F.col("i").alias("id"), F.col("k_eff").alias("value"))


@sampled("ShepardResidual", aliases={"shepard_residual": {"k": 15}, "shepard": {"k": 15}}, reads=_HIGH)
def shepard_residual(s: Spaces, k: int = 15) -> DataFrame:
    return nb.shepard_residual(s.edges("high", k), s.low).select(F.col("i").alias("id"), F.col("residual").alias("value"))


@sampled("OutlierScore", aliases={n: {"k": 20} for n in ("outlier_score", "lof", "outlier")}, reads=_LOW)
def outlier_score(s: Spaces, k: int = 20) -> DataFrame:
    return nb.outlier_factor(s.edges("low", k)).select(F.col("i").alias("id"), F.col("lof").alias("value"))


@sampled("LocalSpectralAnalysis", aliases={"participation_ratio": {"k": 25}, "local_spectral_analysis": {"k": 25}}, reads=_LOW)
def participation(s: Spaces, k: int = 25) -> DataFrame:
    return nb.local_spectrum(s.edges("low", k), s.low).select(F.col("i").alias("id"), F.col("participation").alias("value"))


@sampled("TangentSpaceApproximation", aliases={"tangent_space": {"k": 25}}, reads=_LOW)
def tangent_dimension(s: Spaces, k: int = 25, share: float = 0.95) -> DataFrame:
    return nb.local_spectrum(s.edges("low", k), s.low, share).select(F.col("i").alias("id"), F.col("dimension").cast("double").alias("value"))


@sampled("SilhouetteScore", aliases={"silhouette": {}, "silhouette_score": {}})
def silhouette(s: Spaces) -> DataFrame:
    return st.silhouette(s.low, s.labels).select("id", F.col("silhouette").alias("value"))


@metric("KMeansStratification", aliases={"kmeans_stratification": {"seed": 42}, "stratification": {"seed": 42}})
def kmeans_stratification(s: Spaces, seed: int = 42) -> DataFrame:
    k = s.labels.select("label").distinct().count()
    return comparison.adjusted_rand(comparison.kmeans(s.low, k, seed).join(s.labels, "id"), "cluster", "label")


@metric("FractalDimension", aliases={"fractal_dimension": {"steps": 10}, "fractal_dim": {"steps": 10}})
def fractal_dimension(s: Spaces, steps: int = 10) -> DataFrame:
    return st.fractal_dimension(s.low, steps)


@metric("CKA", aliases={"cka": {}, "cka_linear": {}})
def cka(s: Spaces) -> DataFrame:
    return st.linear_cka(s.high, s.low)


@metric("cka_rbf")
def cka_rbf(s: Spaces) -> DataFrame:
    return comparison.rbf_cka(s.high, s.low)


@metric("PearsonCorrelation", aliases={"pearson_correlation": {"pairs": 100}})
def pearson(s: Spaces, pairs: int = 100) -> DataFrame:
    return comparison.pearson_distances(s.high, s.low, pairs)


@metric("GroundTruthPreservation", aliases={"preservation": {}})
def preservation(s: Spaces, pairs: int = 50_000, only_far: bool = False) -> DataFrame:
    return comparison.preservation(s.high, s.low, pairs, only_far)


@metric("GeodesicDistanceCorrelation", aliases={"geodesic_correlation": {}, "geodesic_distance_correlation": {}})
def geodesic_correlation(s: Spaces, k: int = 10, sources: int = 64) -> DataFrame:
    return spectral.geodesic_correlation(s.high, s.low, k, sources)


@metric("AffinitySpectrum", aliases={"affinity_spectrum": {"top": 25}}, per_sample=lambda s, **p: _affinity_detail(s, **p))
def affinity_spectrum(s: Spaces, top: int = 25, k: int = 15) -> DataFrame:
    """The largest of the first ``top`` eigenvalues of the symmetric diffusion operator; :func:`evaluate_detailed` gives these, by place."""
    return _spectrum(s, top, k).agg(F.max("value"))


def _affinity_detail(s: Spaces, top: int = 25, k: int = 15) -> DataFrame:
    return _spectrum(s, top, k).select(F.col("place").cast("long").alias("id"), "value")


def _spectrum(s: Spaces, top: int, k: int) -> DataFrame:
    return spectral.spectrum(spectral.symmetric_operator(spectral.gaussian_edges(s.high, k)), top)


@metric("SpectralGapRatio", aliases={"spectral_gap_ratio": {}})
def spectral_gap_ratio(s: Spaces, k: int = 15) -> DataFrame:
    return spectral.gap_ratio(_spectrum(s, 2, k))


@metric("SpectralDecayRate", aliases={"spectral_decay_rate": {"top": 20}})
def spectral_decay_rate(s: Spaces, top: int = 20, k: int = 15) -> DataFrame:
    return spectral.decay_rate(_spectrum(s, top, k), top)


@metric("DiffusionSpectralEntropy", aliases={"diffusion_spectral_entropy": {"t": 3}, "dse": {"t": 3}})
def diffusion_spectral_entropy(s: Spaces, t: int = 3, top: int = 50, k: int = 15) -> DataFrame:
    """Over the ``top`` largest eigenvalues; with as many as points, over all."""
    return spectral.spectral_entropy(_spectrum(s, top, k), t)


@metric("PersistentHomology", aliases={"persistent_homology": {}, "beta_0": {"dimension": 0}, "betti_0": {"dimension": 0}, "beta_1": {}, "betti_1": {}})
def persistent_homology(s: Spaces, dimension: int = 1, threshold: float = 0.1, relative: bool = False, most: int = 500, seed: int = 0) -> DataFrame:
    """How many finite bars of the embedding are longer than the threshold, over at most ``most`` points by hash."""
    return homology.persistent_features(homology.bars(s.low, most, seed), dimension, threshold, relative).select(F.col("n").cast("double"))


@metric("MagnitudeDimension", aliases={"magnitude_dimension": {}})
def magnitude_dimension(s: Spaces, n_scales: int = 20, share: float = 0.95) -> DataFrame:
    return magnitude.magnitude_dimension(s.low, n_scales, share)


@metric("NoOp")
def no_op(s: Spaces) -> DataFrame:
    return s.low.agg(F.lit(0.0).alias("value"))


def list_metrics() -> list[str]:
    return sorted(METRICS)


def get_metric(name: str) -> Metric:
    if name not in METRICS:
        raise KeyError(f"no metric {name}; there are {', '.join(list_metrics())}")
    return METRICS[name]


def _prepare(spaces: Spaces, asked: dict[str, tuple[str, dict]]) -> None:
    """Search each side's neighbours once, for the largest k that is needed."""
    most: dict[str, int] = {}
    for name, given in asked.values():
        m = get_metric(name)
        params = m.parameters(given)
        for side, parameter in m.reads:
            if parameter in params:
                most[side] = max(most.get(side, 0), params[parameter])
    for side, k in most.items():
        spaces.edges(side, k)


def evaluate(high: DataFrame, low: DataFrame, metrics: dict[str, dict] | list[str], labels: DataFrame | None = None, sample: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """metric, value: one row for each metric and combination of its list parameters; an unknown name is a KeyError.

    ``sample`` takes the embedding and gives the rows to keep, of all tables.
    """
    asked = unrolled({m: {} for m in metrics} if isinstance(metrics, list) else metrics)
    spaces = spaces_of(high, low, labels, sample)
    _prepare(spaces, asked)
    rows = []
    for label, (name, given) in asked.items():
        m = get_metric(name)
        one = m.compute(spaces, **m.parameters(given))
        rows.append(one.select(F.lit(label).alias("metric"), F.col(f"`{one.columns[0]}`").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, rows)


def spaces_of(high: DataFrame, low: DataFrame, labels: DataFrame | None = None, sample: Callable[[DataFrame], DataFrame] | None = None) -> Spaces:
    if sample is None:
        return Spaces(high, low, labels)
    kept = materialize(sample(low), "sampled")
    follow = lambda t: t.join(kept.select("id"), "id", "left_semi") if t is not None else None
    return Spaces(follow(high), kept, follow(labels))


def evaluate_detailed(high: DataFrame, low: DataFrame, name: str, labels: DataFrame | None = None, **given) -> tuple[DataFrame, DataFrame | None]:
    """The value (one row), and id, value of every point where the metric has one."""
    m = get_metric(name)
    spaces, params = Spaces(high, low, labels), m.parameters(given)
    _prepare(spaces, {name: (name, given)})
    value = m.compute(spaces, **params)
    return value.select(F.col(f"`{value.columns[0]}`").cast("double").alias("value")), m.per_sample(spaces, **params) if m.per_sample else None
