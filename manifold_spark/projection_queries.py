"""Queries of projections, spectra, homology, robust parts and of operators over traces, matrices and files.

Where SQL has no eigenvectors or iterations a query has none; `tests/test_projections.py` and
`tests/test_more_operators.py` hold those operators against dense numpy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import registry, runs
from .operators import archetypes, clustering, comparison, correction, homology, local, magnitude, models, phate, robust, sampling, scaling, spectral, statistics, tsne, umap, vectors
from .operators import neighbours as nb
from .queries import _K15, _KSTAR, _LID, ALL, UNIFORM, _knn, _points, query, table
from .session import materialize, read_table, scratch_path
from .sources import files, sinks

_ENTRIES = "SELECT vec_id AS id, unnest(range(64)) AS p, unnest(embedding::DOUBLE[]) AS x FROM embeddings"


def _entries(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", *more, F.posexplode("vec").alias("p", "x"))


# projections --------------------------------------------------------------------------


@query()
def landmark_scaling(spark, sf_dir):
    """Metric scaling to two dimensions: 256 landmarks, every point placed."""
    return _entries(scaling.scale(table(spark, sf_dir), 2))


@query()
def potential_embedding(spark, sf_dir):
    """Potential distances over 200 landmarks, t by the knee of the entropy."""
    return _entries(phate.embed(table(spark, sf_dir), 2, n_landmarks=200))


@query()
def fuzzy_layout(spark, sf_dir):
    """The layout of the fuzzy graph of 15 neighbours after 20 rounds."""
    return _entries(umap.embed(table(spark, sf_dir), 2, rounds=20))


@query()
def neighbour_affinities(spark, sf_dir):
    """The symmetric affinities of perplexity 30."""
    return tsne.affinities(table(spark, sf_dir), 30)


@query()
def tsne_layout(spark, sf_dir):
    """Twelve rounds of descent from the principal components."""
    return _entries(tsne.embed(table(spark, sf_dir), rounds=12))


@query()
def fuzzy_graph(spark, sf_dir):
    return umap.fuzzy_graph(table(spark, sf_dir), 15)


@query()
def robust_parts(spark, sf_dir):
    """The low-rank and sparse parts of all vectors."""
    parts = robust.decompose(table(spark, sf_dir)).table
    return parts.select("id", F.posexplode(F.arrays_zip("low", "sparse")).alias("p", "v")).select("id", "p", "v.low", "v.sparse")


@query()
def diffusion_map(spark, sf_dir):
    """Fitted to the half of the points with the smallest hashes, extended to all."""
    points = table(spark, sf_dir)
    return _entries(models.fit_diffusion(points, 2, fit_fraction=0.5).transform(points))


@query("WITH f AS (SELECT vec_id AS id FROM embeddings WHERE " + UNIFORM.format("vec_id") + " < 0.5) SELECT vec_id AS id, vec_id IN (SELECT id FROM f) AS fitted FROM embeddings")
def fitted_share(spark, sf_dir):
    """The points that a model with a fit fraction of a half is fitted to."""
    points = table(spark, sf_dir)
    part = models.fraction(points, 0.5).select("id", F.lit(True).alias("fitted"))
    return points.select("id").join(part, "id", "left").select("id", F.coalesce("fitted", F.lit(False)).alias("fitted"))


@query()
def algorithm_by_name(spark, sf_dir):
    return _entries(models.run_algorithm(table(spark, sf_dir), "PCA", k=3, fit_fraction=0.5))


@query()
def tangent_alignment(spark, sf_dir):
    """Coordinates that make the patches of 15 neighbours linear."""
    return _entries(local.align_tangents(table(spark, sf_dir), 15, 2))


@query()
def robust_local_pca(spark, sf_dir):
    """The local spectra of trimmed patches of 20 neighbours."""
    found = local.local_pca(table(spark, sf_dir), 20)
    return found.select("id", "dimension", "support", *(F.round(c, 6).alias(c) for c in ("variance", "condition", "effective_rank")))


@query()
def archetypal_shares(spark, sf_dir):
    """Each point's shares of three corners."""
    return _entries(archetypes.analyse(table(spark, sf_dir), 3, rounds=10))


@query()
def condensation_sampling(spark, sf_dir):
    """A balanced sample over the groups that ten rounds of condensation leave."""
    return sampling.condensed(table(spark, sf_dir), rounds=10).select("id")


@query(f"WITH {_K15}, {_knn('e', 'p', 60)}, {_KSTAR}, f AS (SELECT i, sum(w) * sum(w) / sum(w * w) AS k FROM kern GROUP BY i) SELECT i AS id, round(k / k_star, 5) AS ratio, k / k_star > 1.0 OR k / k_star < 0.5 AS mismatched FROM f JOIN kstar USING (i)")
def mismatch_labels(spark, sf_dir):
    """The points whose kernel reaches beyond or stays far below their k-star."""
    points = table(spark, sf_dir)
    edges = materialize(nb.knn(points, 60), "neighbours")
    return correction.mismatch(points, nb.kernel(edges.where("rank <= 15")), 60, edges=edges).withColumn("ratio", F.round("ratio", 5))


@query()
def selective_correction(spark, sf_dir):
    """Principal components after all steps of the correction, in which mismatched points move."""
    points = table(spark, sf_dir)
    edges = materialize(nb.knn(points, 60), "neighbours")
    flagged = correction.mismatch(points, nb.kernel(edges.where("rank <= 15")), 60, edges=edges)
    return _entries(correction.correct(materialize(comparison.pca(points, 2), "embedding"), materialize(flagged, "flagged")))


# topology and spectra -----------------------------------------------------------------


@query()
def persistent_homology(spark, sf_dir):
    """Bars of dimensions 0 and 1 of the Rips filtration, over 300 points by hash."""
    return homology.bars(table(spark, sf_dir), 300)


@query()
def magnitude_profile(spark, sf_dir):
    """Magnitude and its growth at six scales about the nearest distances."""
    return magnitude.profile(magnitude.magnitudes(table(spark, sf_dir), [0.5, 1.0, 1.5, 2.0, 3.0, 4.0], tolerance=1e-6))


@query()
def graph_spectrum(spark, sf_dir):
    """The 20 largest eigenvalues of the symmetric diffusion operator."""
    return spectral.spectrum(spectral.symmetric_operator(spectral.gaussian_edges(table(spark, sf_dir), 15)), 20)


@query()
def spectral_summary(spark, sf_dir):
    """Gap ratio, decay rate, entropy and topology of one spectrum."""
    points = table(spark, sf_dir)
    values = spectral.spectrum(spectral.symmetric_operator(spectral.gaussian_edges(points, 15)), 20)
    return spectral.topology(points, values).crossJoin(spectral.decay_rate(values)).crossJoin(spectral.spectral_entropy(values))  # a row each


@query()
def spectral_counts(spark, sf_dir):
    values = spectral.spectrum(spectral.symmetric_operator(spectral.gaussian_edges(table(spark, sf_dir), 15)), 20)
    return spectral.spectral_counts(values, [1, 5, 10, 50])


@query()
def diffusion_curvature(spark, sf_dir):
    operator = nb.row_normalised(spectral.gaussian_edges(table(spark, sf_dir), 10))
    return spectral.diffusion_curvature(operator, 2, every=True).select("i", F.round("curvature", 6).alias("curvature"))


@query()
def condensation(spark, sf_dir):
    """The number of groups in the first eight rounds of diffusion condensation."""
    return spectral.condense(table(spark, sf_dir), rounds=8)


@query(f"WITH {ALL}, {_knn('e', 'p', 5)}, d AS (SELECT i, count(*) AS deg FROM e GROUP BY i), x AS ({_ENTRIES}), c AS (SELECT sum(a.x * b.x / sqrt(u.deg * v.deg)) AS c FROM e JOIN x a ON e.i = a.id JOIN x b ON e.j = b.id AND a.p = b.p JOIN d u ON e.i = u.i JOIN d v ON e.j = v.i) SELECT round(((SELECT sum(x * x) FROM x) - (SELECT c FROM c)) / 64, 4) AS smoothness")
def graph_smoothness(spark, sf_dir):
    """The mean of x'Lx over all columns, with the normalised Laplacian of the directed graph of five neighbours."""
    points = table(spark, sf_dir)
    return spectral.smoothness(nb.knn(points, 5), points).select(F.round("smoothness", 4).alias("smoothness"))


# labels and layers --------------------------------------------------------------------

_FOUR = [(1, 16), (17, 16), (33, 16), (49, 16)]


def _layer_sql(number: int, first: int, length: int) -> str:
    n = f"l{number}"
    points, near = _points(n, f"[{first}:{first + length - 1}]"), _knn(f"e{number}", n, 20)
    side = "(SELECT vec_id AS id, CAST(label >= 5 AS INT) AS side FROM embeddings)"
    return (
        f"SELECT '{n}' AS layer, lid, auroc, (SELECT count(*) FROM embeddings) AS n, {length} AS dim FROM (WITH {points}, {near}, {_LID.format(f's{number}', f'e{number}')} SELECT round(avg(lid), 4) AS lid FROM s{number}), "
        f"(WITH x AS (SELECT vec_id AS id, unnest(range({length})) AS p, unnest((embedding::DOUBLE[])[{first}:{first + length - 1}]) AS x FROM embeddings), w AS (SELECT p, avg(x) FILTER (WHERE side = 1) - avg(x) FILTER (WHERE side = 0) AS w FROM x JOIN {side} USING (id) GROUP BY p), "
        f"q AS (SELECT id, max(side) AS side, sum(x * w) AS s FROM x JOIN w USING (p) JOIN {side} USING (id) GROUP BY id) SELECT round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END), 5) AS auroc FROM q a JOIN q b ON a.side = 1 AND b.side = 0)"
    )


@query(" UNION ALL ".join(_layer_sql(i, a, n) for i, (a, n) in enumerate(_FOUR)))
def layer_geometry(spark, sf_dir):
    """Intrinsic dimension and separation of the labels in four layers, slices that cover the whole vectors."""
    sides = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("side"))
    layers = {f"l{i}": table(spark, sf_dir, a, n) for i, (a, n) in enumerate(_FOUR)}
    return comparison.layer_geometry(layers, sides).select("layer", F.round("lid", 4).alias("lid"), F.round("auroc", 5).alias("auroc"), "n", "dim")


@query()
def granger_scores(spark, sf_dir):
    """Signed scores of all pairs of event types: daily means over users, first differences."""
    cells = read_table(spark, sf_dir, "events").select(F.to_date("ts").alias("t"), F.col("event_type").alias("gene"), "value")
    return statistics.granger_scores(cells, downsample=1)


# traces and matrices ------------------------------------------------------------------


@query(
    "WITH t AS (SELECT vec_id % 7 AS trace, vec_id // 7 AS step, unnest(range(32)) AS p, unnest((embedding::DOUBLE[])[1:32]) AS a, unnest((embedding::DOUBLE[])[33:64]) AS b FROM embeddings), "
    "n AS (SELECT trace, max(step) + 1 AS n FROM t GROUP BY trace), g AS (SELECT trace, n, s AS step, s * (n - 1) / 24.0 AS place, least(CAST(floor(s * (n - 1) / 24.0) AS BIGINT), n - 2) AS before FROM n, range(25) r(s)), "
    "r AS (SELECT g.trace, g.step, u.p, u.a + (v.a - u.a) * (place - before) AS a, u.b + (v.b - u.b) * (place - before) AS b FROM g JOIN t u ON g.trace = u.trace AND u.step = before JOIN t v ON g.trace = v.trace AND v.step = before + 1 AND u.p = v.p) "
    "SELECT trace, step, round(1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 6) AS residual FROM r GROUP BY trace, step"
)
def trajectory_resampling(spark, sf_dir):
    """Two trajectories at 25 even places."""
    t = read_table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("trace"), F.expr("vec_id div 7").alias("step"), F.col("embedding").cast("array<double>").alias("v"))
    a, b = (t.select("trace", "step", F.slice("v", first, 32).alias("vec")) for first in (1, 33))
    return vectors.align(a, b, "resample", 25).select("trace", "step", F.round("residual", 6).alias("residual"))


_MATRICES = f"SELECT id % 4 AS model, id // 4 % 5 AS step, id // 20 AS i, p AS j, x AS w FROM ({_ENTRIES})"


def _matrices(spark, sf_dir) -> DataFrame:
    """Four models' matrices in five steps."""
    x = _entries(table(spark, sf_dir))
    return x.select((F.col("id") % 4).alias("model"), F.expr("id div 4 % 5").alias("step"), F.expr("id div 20").alias("i"), F.col("p").alias("j"), F.col("x").alias("w"))


@query(f"WITH m AS ({_MATRICES}), d AS (SELECT step, a, b, sqrt(sum(d * d)) AS d FROM (SELECT p.step, p.a, p.b, coalesce(x.w, 0) - coalesce(y.w, 0) AS d FROM (SELECT DISTINCT u.step, u.model AS a, v.model AS b, k.i, k.j FROM (SELECT DISTINCT step, model FROM m) u JOIN (SELECT DISTINCT step, model FROM m) v ON u.step = v.step AND u.model < v.model JOIN (SELECT DISTINCT step, i, j FROM m) k ON k.step = u.step) p LEFT JOIN m x ON x.step = p.step AND x.model = p.a AND x.i = p.i AND x.j = p.j LEFT JOIN m y ON y.step = p.step AND y.model = p.b AND y.i = p.i AND y.j = p.j) GROUP BY step, a, b) SELECT step, round(avg(d), 6) AS spread FROM d GROUP BY step")
def operator_spread(spark, sf_dir):
    return vectors.spread(_matrices(spark, sf_dir)).select("step", F.round("spread", 6).alias("spread"))


@query(f"WITH m AS ({_MATRICES}), a AS (SELECT i, j, w FROM m WHERE step = 0 AND model = 0), b AS (SELECT i, j, w FROM m WHERE step = 1 AND model = 0) SELECT round(sqrt(sum((coalesce(a.w, 0) - coalesce(b.w, 0)) ^ 2)), 6) AS distance FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j")
def operator_distance(spark, sf_dir):
    m = _matrices(spark, sf_dir)
    return vectors.operator_distance(m.where("step = 0 and model = 0"), m.where("step = 1 and model = 0")).select(F.round("distance", 6).alias("distance"))


@query(f"WITH {_points('a', '[1:32]')}, {_points('b', '[33:64]')}, {_knn('ea', 'a', 8)}, {_knn('eb', 'b', 8)}, s AS (SELECT i, j, sum(w) AS w FROM (SELECT i, j, 1 / 8 * 0.25 AS w FROM ea UNION ALL SELECT i, j, 1 / 8 * 0.75 FROM eb) GROUP BY i, j) SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 6) AS w FROM s")
def merged_operators(spark, sf_dir):
    """The weighted mean of two modalities' neighbour operators."""
    steps = [nb.row_normalised(nb.knn(table(spark, sf_dir, first, 32), 8).select("i", "j", F.lit(1.0).alias("w"))) for first in (1, 33)]
    return vectors.merge_operators(steps, [0.25, 0.75]).select("i", "j", F.round("w", 6).alias("w"))


@query(f"WITH e AS ({_ENTRIES}), s AS (SELECT id AS component, CASE WHEN p < 16 THEN 'rna' WHEN p < 40 THEN 'splice' ELSE 'methyl' END AS channel, sum(x * x) AS s FROM e GROUP BY ALL) SELECT component, channel, round(s / sum(s) OVER (PARTITION BY component), 6) AS share FROM s")
def channel_shares(spark, sf_dir):
    loadings = _entries(table(spark, sf_dir)).select(F.col("id").alias("component"), F.col("p").alias("dimension"), F.col("x").alias("loading"))
    return vectors.channel_shares(loadings, {"rna": 16, "splice": 24, "methyl": 24}).select("component", "channel", F.round("share", 6).alias("share"))


@query(f"SELECT id % 20 AS sample_id, p, round(avg(x), 6) AS x FROM ({_ENTRIES}) GROUP BY ALL")
def token_pooling(spark, sf_dir):
    """The mean vectors of samples' tokens."""
    tokens = table(spark, sf_dir).select((F.col("id") % 20).alias("sample_id"), F.expr("id div 20").alias("position"), "vec")
    return vectors.pool(tokens).select("sample_id", F.posexplode("vec").alias("p", "x")).withColumn("x", F.round("x", 6))


@query("SELECT vec_id % 20 AS sample_id, arg_max(vec_id, vec_id // 20) AS last, arg_min(vec_id, vec_id // 20) AS first FROM embeddings GROUP BY 1")
def token_ends(spark, sf_dir):
    """The first and last token of each sample."""
    tokens = read_table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 20).alias("sample_id"), F.expr("vec_id div 20").alias("position"), F.array("vec_id").alias("vec"))
    end = lambda how, name: vectors.pool(tokens, how).select("sample_id", F.get("vec", F.lit(0)).alias(name))
    return end("last_token", "last").join(end("first_token", "first"), "sample_id")


@query(f"SELECT round(max(s), 6) AS spread, max(s) > 1e-6 AS \"distinct\" FROM (SELECT stddev_pop(x) AS s FROM ({_ENTRIES}) GROUP BY id % 50, p)")
def distinct_layers(spark, sf_dir):
    rows = table(spark, sf_dir).select((F.col("id") % 50).alias("sample_id"), F.expr("id div 50").alias("layer"), "vec")
    return vectors.layers_differ(rows).select(F.round("spread", 6).alias("spread"), "distinct")


# files, splits and runs ---------------------------------------------------------------


@query(f"SELECT id, p + 1 AS p, round(x, 6) AS x FROM ({_ENTRIES})")
def saved_embeddings(spark, sf_dir):
    """Points written as a csv table with a column for each dimension, and read back."""
    path = scratch_path(spark, "saved-embeddings")
    sinks.save_embeddings(table(spark, sf_dir), path, "csv")
    return sinks.load_embeddings(spark, path, "csv").select(F.col("id").cast("long").alias("id"), F.posexplode("vec").alias("p", "x")).select("id", (F.col("p") + 1).alias("p"), F.round("x", 6).alias("x"))


@query("WITH u AS (SELECT o_orderkey, row_number() OVER (ORDER BY " + UNIFORM.format("o_orderkey") + ", o_orderkey) AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN r <= CAST(floor(n * 0.2) AS BIGINT) THEN 'test' ELSE 'train' END AS part FROM u")
def train_test_split(spark, sf_dir):
    train, test = files.split(read_table(spark, sf_dir, "orders").select("o_orderkey"), 0.2, "o_orderkey")
    return train.withColumn("part", F.lit("train")).union(test.withColumn("part", F.lit("test")))


@query("SELECT vec_id AS id, list_position(list_concat((embedding::DOUBLE[])[33:64], (embedding::DOUBLE[])[1:32]), list_max(embedding::DOUBLE[])) AS place FROM embeddings")
def joined_channels(spark, sf_dir):
    """Two channels one after another, and where the largest entry is then."""
    both = files.join_channels({"b": table(spark, sf_dir, 33, 32), "a": table(spark, sf_dir, 1, 32)})
    return both.select("id", F.array_position("vec", F.array_max("vec")).cast("int").alias("place"))


@query("SELECT event_id AS step FROM events WHERE event_id % 50 = 0 OR event_type = (SELECT min(event_type) FROM events)")
def probes_due(spark, sf_dir):
    """Every 50th step, and those of one kind of event."""
    e = read_table(spark, sf_dir, "events")
    kind = e.agg(F.min("event_type")).first()[0]
    steps = e.select(F.col("event_id").alias("step"), F.col("user_id").alias("epoch"), F.when(F.col("event_type") == kind, "checkpoint").otherwise("batch").alias("event"))
    return runs.due(steps, every_steps=50, on_checkpoint=True).select("step")


@query("SELECT p_partkey, p_brand AS \"part.brand\", p_size AS \"part.shape.size\", p_retailprice AS \"part.price\" FROM part")
def flattened_fields(spark, sf_dir):
    """Nested fields as columns named by their way down."""
    nested = read_table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.struct(F.col("p_size").alias("size")).alias("shape"), F.col("p_retailprice").alias("price")).alias("part"))
    return runs.flattened(nested)


@query(f"WITH {_points('h')}, {_points('l', '[1:8]')}, {_knn('a', 'h', 9)}, {_knn('b', 'l', 9)}, k AS (SELECT unnest([3, 6, 9]) AS k) SELECT 'knn_preservation' AS metric, CAST(k AS INT) AS k, round(count(b.i) / (k * (SELECT count(*) FROM h)), 6) AS value FROM k JOIN a ON a.rank <= k LEFT JOIN b ON a.i = b.i AND a.j = b.j AND b.rank <= k GROUP BY k")
def metric_curve(spark, sf_dir):
    """A metric for a list of its parameter, as a curve."""
    scores = registry.evaluate(table(spark, sf_dir), table(spark, sf_dir, 1, 8), {"knn_preservation": {"k": [3, 6, 9]}})
    return runs.curves(scores).select("metric", "k", F.round("value", 6).alias("value"))


@query("SELECT l_shipmode_k AS metric, v AS value FROM (SELECT 'quantity' AS l_shipmode_k, round(avg(l_quantity), 6) AS v FROM lineitem UNION ALL SELECT 'discount', round(avg(l_discount), 6) FROM lineitem)")
def results_table(spark, sf_dir):
    """Averages of a table as rows of results."""
    found = read_table(spark, sf_dir, "lineitem").agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount")).first()
    return sinks.results_table(spark, found.asDict()).select("metric", "value")


@query()
def reeb_of_first_component(spark, sf_dir):
    """The Reeb graph of the first principal component over the graph of eight neighbours."""
    p = table(spark, sf_dir)
    nodes, links, _ = clustering.reeb_graph(clustering.lens_values(p, "pca1"), materialize(nb.knn(p, 8), "near"), overlap=0.25)
    return clustering.graph_summary(nodes, links)
