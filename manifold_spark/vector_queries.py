"""Registered queries of the operators on whole vectors, graphs and generators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import runs
from .operators import clustering, comparison, spectral, statistics, vectors
from .operators import neighbours as nb
from .queries import _AVG_RANK, ALL, ONE, TWO, UNIFORM, query, table
from .session import read_table
from .sources import synthetic

_DIMS = "SELECT id, unnest(range(len(v))) AS p, unnest(v) AS x FROM "


def _halves(spark, sf_dir):
    return table(spark, sf_dir, 1, 32), table(spark, sf_dir, 33, 32)


def _side_tables(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return nb.points(e.where("label < 5")), nb.points(e.where("label >= 5"))


def _long(df, digits=6):
    return df.select("id", F.posexplode("vec").alias("p", "x")).select("id", "p", F.round("x", digits).alias("x"))


# scaling and scalar functions --------------------------------------------------


@query(f"WITH {ALL}, x AS ({_DIMS} p) SELECT id, p, round((x - min(x) OVER w) / CASE WHEN max(x) OVER w > min(x) OVER w THEN max(x) OVER w - min(x) OVER w ELSE 1 END, 6) AS x FROM x WINDOW w AS (PARTITION BY p)")
def scale_dimensions(spark, sf_dir):
    return _long(vectors.min_max(table(spark, sf_dir)))


@query(f"WITH {ALL}, x AS ({_DIMS} p) SELECT id, p, round(sign(x) * greatest(abs(x) - 0.05, 0), 6) AS x FROM x")
def soft_threshold(spark, sf_dir):
    return _long(table(spark, sf_dir).select("id", F.transform("vec", lambda x: vectors.soft_threshold(x, 0.05)).alias("vec")))


@query(
    f"WITH {ALL}, r AS (SELECT id, p, CAST(floor(abs(x) * 1000) AS BIGINT) % 4 AS g FROM ({_DIMS} p)), g AS (SELECT id, p, CASE WHEN g < 3 THEN CAST(g AS DOUBLE) END AS g FROM r), f AS (SELECT p, avg(g) / 2 AS f FROM g WHERE id % 2 = 0 GROUP BY p) SELECT id, p, round(coalesce((g - 2 * f) / CASE WHEN 2 * f * (1 - f) > 0 THEN sqrt(2 * f * (1 - f)) ELSE 1 END, 0), 6) AS x FROM g JOIN f USING (p)"
)
def genotype_normalisation(spark, sf_dir):
    """Codes 0 to 2 and -1 for missing ones, scaled by each variant's frequency among the even ids."""
    code = lambda x: F.floor(F.abs(x) * 1000) % 4
    t = table(spark, sf_dir).select("id", F.transform("vec", lambda x: F.when(code(x) == 3, -1.0).otherwise(code(x).cast("double"))).alias("vec"))
    return _long(vectors.genotypes(t, t.where("id % 2 = 0")))


@query("WITH c AS (SELECT vec_id AS id, (embedding::DOUBLE[])[1] * 90 AS lat, (embedding::DOUBLE[])[2] * 180 AS lon FROM embeddings), h AS (SELECT a.id AS i, b.id AS j, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM c a JOIN c b ON a.id < b.id) SELECT i, j, round(2 * 6371 * atan2(sqrt(h), sqrt(1 - h)), 3) AS km FROM h")
def haversine(spark, sf_dir):
    at = lambda n, by: (F.col("embedding")[n].cast("double") * by)
    places = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(0, 90).alias("lat"), at(1, 180).alias("lon"))
    # by a product and a floor, as the SQL's engine rounds; by decimals it would take longer than the distances
    metres = F.when(F.isnan("km"), F.col("km")).otherwise(F.floor(F.col("km") * 1000 + 0.5) / 1000)
    return vectors.all_haversine(places).select("i", "j", metres.alias("km"))


@query(f"WITH {ALL}, k AS (SELECT a.id AS i, b.id AS j, list_dot_product(a.v, b.v) AS k FROM p a CROSS JOIN p b), c AS (SELECT i, j, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS c FROM k) SELECT i, j, round(c, 6) AS c FROM c WHERE i <= j")
def center_gram_matrix(spark, sf_dir):
    return vectors.center_gram(table(spark, sf_dir)).select("i", "j", F.round("c", 6).alias("c"))


# losses and comparisons ---------------------------------------------------------


@query(f"WITH {ONE}, {TWO} SELECT round(avg(power(x - y, 2)), 8) AS mse FROM (SELECT unnest(one.v) AS x, unnest(two.v) AS y FROM one JOIN two USING (id))")
def mse_loss(spark, sf_dir):
    return vectors.mean_squared_error(*_halves(spark, sf_dir)).select(F.round("mse", 8).alias("mse"))


_KERNELS = " + ".join(f"exp(-d / (w / 4 * {2.0**i}))" for i in range(5))


@query(
    f"WITH x AS (SELECT CAST(label >= 5 AS INT) AS side, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.side AS s, b.side AS t, power(list_distance(a.v, b.v), 2) AS d FROM x a CROSS JOIN x b), n AS (SELECT sum(d) / (count(*) - sqrt(count(*))) AS w FROM d), k AS (SELECT s, t, {_KERNELS} AS k FROM d, n) SELECT round(avg(k) FILTER (WHERE s = 0 AND t = 0) + avg(k) FILTER (WHERE s = 1 AND t = 1) - 2 * avg(k) FILTER (WHERE s = 0 AND t = 1), 7) AS mmd FROM k"
)
def mmd_loss(spark, sf_dir):
    return vectors.discrepancy(*_side_tables(spark, sf_dir)).select(F.round("mmd", 7).alias("mmd"))


@query("WITH m AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, CAST(label >= 5 AS INT) AS side FROM embeddings), d AS (SELECT list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r FROM m a JOIN m b ON a.side = 0 AND b.side = 1) SELECT round(avg(greatest(d - 0.01, 0)), 6) AS density_loss FROM d WHERE r <= 5")
def density_loss(spark, sf_dir):
    return vectors.density_loss(*_side_tables(spark, sf_dir)).select(F.round("density_loss", 6).alias("density_loss"))


@query(f"WITH {ONE}, {TWO}, d AS (SELECT list_distance(a.v, b.v) AS x, list_distance(c.v, d.v) AS y FROM one a JOIN one b ON a.id < b.id JOIN two c ON c.id = a.id JOIN two d ON d.id = b.id) SELECT round(corr(x, y), 6) AS pearson FROM d")
def distance_correlation(spark, sf_dir):
    return comparison.distance_correlation(*_halves(spark, sf_dir)).select(F.round("pearson", 6).alias("pearson"))


_CKA = "round(sum(CASE WHEN p < 32 AND q >= 32 THEN c * c END) / sqrt(sum(CASE WHEN p < 32 AND q < 32 THEN c * c END) * sum(CASE WHEN p >= 32 AND q >= 32 THEN c * c END)), 6)"


@query(f"WITH {ALL}, z AS (SELECT id, p, x - avg(x) OVER (PARTITION BY p) AS z FROM ({_DIMS} p)), g AS (SELECT a.p, b.p AS q, sum(a.z * b.z) AS c FROM z a JOIN z b USING (id) GROUP BY a.p, b.p) SELECT {_CKA} AS cka FROM g")
def cka_linear(spark, sf_dir):
    return statistics.linear_cka(*_halves(spark, sf_dir)).select(F.round("cka", 6).alias("cka"))


@query()
def anisotropy(spark, sf_dir):
    """Share of the largest singular value of the centred data: d x d moments summed in Spark, then one small eigenproblem (tests: numpy)."""
    import numpy as np

    g = statistics.gram(table(spark, sf_dir)).toPandas()  # d x d rows, whatever the number of points
    d = int(g["p"].max()) + 1 if len(g) else 1
    m = np.zeros((d, d))
    m[g["p"], g["q"]] = g["c"]
    s = np.sqrt(np.clip(np.linalg.eigvalsh(m), 0, None))
    return spark.createDataFrame([(round(float(s[-1] / s.sum()), 6),)], "anisotropy double")


# run tables ---------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY ALL")
def pivot_table(spark, sf_dir):
    p = runs.pivot(read_table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag", "l_linestatus"])
    return p.select("l_returnflag", "l_linestatus", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query("SELECT l_discount, l_tax, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std FROM lineitem GROUP BY ALL")
def parameter_sensitivity(spark, sf_dir):
    s = runs.sensitivity(read_table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"], ["l_quantity"])
    return s.select("l_discount", "l_tax", F.round("l_quantity_mean", 6).alias("mean"), F.round("l_quantity_std", 6).alias("std"))


@query("SELECT l_orderkey, l_linenumber, 'trustworthiness' AS metric, CAST('0.' || l_orderkey AS DOUBLE) AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'lid_2', l_quantity FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'lid_3', l_tax FROM lineitem")
def log_metrics(spark, sf_dir):
    """Metric values out of log lines: a float, and the entries of an array."""
    line = F.concat(F.lit("trustworthiness: 0."), "l_orderkey", F.lit(" lid: array(["), "l_quantity", F.lit(", "), "l_tax", F.lit("])"))
    logs = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    return runs.metrics_from_text(logs, "line", ["trustworthiness", "lid"])


# merging and alignment ------------------------------------------------------------


@query(f"WITH {ONE}, {TWO} SELECT one.id, unnest(range(32)) AS p, round(unnest(list_transform(range(1, 33), lambda i: 0.7 * one.v[i] + 0.3 * two.v[i])), 6) AS x FROM one JOIN two USING (id)")
def merge_weighted_sum(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return _long(vectors.merge({"a": a, "b": b}, "weighted_sum", {"a": 0.7, "b": 0.3}))


@query(f"WITH {ONE}, {TWO}, s AS (SELECT one.id, one.v AS a, two.v AS b, sqrt(list_dot_product(one.v, one.v)) AS x, sqrt(list_dot_product(two.v, two.v)) AS y FROM one JOIN two USING (id)) SELECT id, unnest(range(64)) AS p, round(unnest(list_concat(list_transform(a, lambda v: v / x), list_transform(b, lambda v: v / y))), 6) AS x FROM s")
def merge_concat(spark, sf_dir):
    """Channels joined on id, each scaled to length 1, side by side."""
    a, b = _halves(spark, sf_dir)
    return _long(vectors.merge({"a": a, "b": b}, normalise=True))


@query(
    "WITH t AS (SELECT vec_id % 7 AS trace, vec_id // 7 AS step, (embedding::DOUBLE[])[1:32] AS a, (embedding::DOUBLE[])[33:64] AS b FROM embeddings) SELECT trace, step, round(1 - list_cosine_similarity(a, b), 6) AS residual FROM t WHERE step % 10 < 9"
)
def trajectory_alignment(spark, sf_dir):
    """Two trajectories on the steps that both have."""
    t = read_table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 7).alias("trace"), F.expr("vec_id div 7").alias("step"), F.col("embedding").cast("array<double>").alias("v"))
    a, b = t.select("trace", "step", F.slice("v", 1, 32).alias("vec")), t.where("step % 10 < 9").select("trace", "step", F.slice("v", 33, 32).alias("vec"))
    return vectors.align(a, b).select("trace", "step", F.round("residual", 6).alias("residual"))


# graphs ----------------------------------------------------------------------------


@query()
def geodesic_correlation(spark, sf_dir):
    """Distances along the neighbour graph from 16 points against straight ones of the embedding (tests: Floyd's algorithm)."""
    return spectral.geodesic_correlation(table(spark, sf_dir), table(spark, sf_dir, 1, 8), 10, 16)


@query()
def communities(spark, sf_dir):
    e = nb.kernel(nb.knn(table(spark, sf_dir), 15))
    return clustering.communities(e, rounds=5, levels=2)


@query()
def spanning_forest(spark, sf_dir):
    """The minimum spanning forest of the graph of ten neighbours: the bars of its components' persistence (tests: Prim's algorithm)."""
    return clustering.spanning_edges(nb.knn(table(spark, sf_dir), 10)).select("a", "b", F.round("d", 5).alias("d"))


@query()
def farthest_points(spark, sf_dir):
    return clustering.farthest_points(table(spark, sf_dir), 20).select("id", "place")


@query()
def reeb_graph(spark, sf_dir):
    """The density lens of whole vectors over the graph of ten neighbours."""
    p = table(spark, sf_dir)
    nodes, links, _ = clustering.reeb_graph(clustering.lens_values(p, "density"), nb.knn(p, 10), overlap=0.25)
    return clustering.graph_summary(nodes, links)


@query()
def classifier(spark, sf_dir):
    labels = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("label"))
    return clustering.classifier(table(spark, sf_dir), labels).select("id", F.round("probability", 4).alias("probability"))


@query(f"WITH {ALL}, k AS (SELECT id, avg(d) AS m FROM (SELECT a.id, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r FROM p a JOIN p b ON a.id <> b.id) WHERE r <= 15 GROUP BY id) SELECT id, round(1 / m, 5) AS lens FROM k")
def density_lens(spark, sf_dir):
    return clustering.density_lens(table(spark, sf_dir)).select("id", F.round("lens", 5).alias("lens"))


# generators --------------------------------------------------------------------------

_U43 = "((CAST('0x' || substr(md5(CAST(range AS VARCHAR) || ':43'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)"


@query(f"WITH r AS (SELECT range AS id, 2 * {UNIFORM.format('range')} - 1 AS u, 2 * {_U43} - 1 AS v FROM range(1000)) SELECT id, round(u, 6) AS x, round(v, 6) AS y, round(u * u - v * v, 6) AS z FROM r")
def saddle(spark, sf_dir):
    s = synthetic.saddle(spark, 1000)
    return s.select("id", *(F.round(F.col("vec")[i], 6).alias(c) for i, c in enumerate("xyz")))


@query(f"SELECT l_orderkey, l_linenumber, {_AVG_RANK.format('l_discount')} AS rank FROM lineitem")
def average_ranks(spark, sf_dir):
    """Ranks of a column with few values, each of which a large share of all rows holds."""
    return statistics.with_average_rank(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount").select("l_orderkey", "l_linenumber", "rank")
