"""Registry of the engine's own queries and of the SQL that they are held against.

``embeddings`` plays a point cloud: all 64 dimensions are the ambient space, the
first 8 the embedding, the two halves two modalities. ``events`` are traces of
users. ``lineitem``, ``orders`` and ``customer`` are run tables, strata and scores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import registry
from .operators import comparison, graph, sampling, statistics
from .operators import neighbours as nb
from .session import materialize, read_table
from .sources import synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, first: int = 1, length: int | None = None) -> DataFrame:
    return nb.points(read_table(spark, sf_dir, "embeddings"), first=first, length=length)


def _points(name: str, cut: str = "") -> str:
    return f"{name} AS (SELECT vec_id AS id, (embedding::DOUBLE[]){cut} AS v FROM embeddings)"


def _knn(name: str, source: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM {source} a JOIN {source} b ON a.id <> b.id) WHERE rank <= {k})"


ALL, LOW, ONE, TWO = _points("p"), _points("low", "[1:8]"), _points("one", "[1:32]"), _points("two", "[33:64]")
UNIFORM = "((CAST('0x' || substr(md5(CAST({} AS VARCHAR) || ':42'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return nb.points(e, length=8).join(e.select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("side")), "id")


# neighbours ------------------------------------------------------------------


@query(f"WITH {ALL}, {_knn('e', 'p', 10)} SELECT i, j, rank, round(d, 5) AS d FROM e")
def knn(spark, sf_dir):
    return nb.knn(table(spark, sf_dir), 10).select("i", "j", "rank", F.round("d", 5).alias("d"))


@query(f"WITH {ALL}, {LOW}, {_knn('h', 'p', 10)}, {_knn('l', 'low', 10)} SELECT h.i, round(count(l.j) / 10.0, 6) AS overlap FROM h LEFT JOIN l ON h.i = l.i AND h.j = l.j GROUP BY h.i")
def knn_preservation(spark, sf_dir):
    return nb.overlap(nb.knn(table(spark, sf_dir), 10), nb.knn(table(spark, sf_dir, 1, 8), 10)).select("i", F.round("overlap", 6).alias("overlap"))


@query(f"WITH {ALL}, {LOW}, {_knn('h', 'p', 25)}, {_knn('l', 'low', 25)}, s AS (SELECT h.i, count(l.j) / 25.0 AS o FROM h LEFT JOIN l ON h.i = l.i AND h.j = l.j GROUP BY h.i) SELECT round(avg(o), 6) AS continuity, round(avg(o) - 25.0 / (count(*) - 1), 6) AS adjusted FROM s")
def continuity(spark, sf_dir):
    s = nb.overlap(nb.knn(table(spark, sf_dir), 25), nb.knn(table(spark, sf_dir, 1, 8), 25))
    return s.agg(F.round(F.avg("overlap"), 6).alias("continuity"), F.round(F.avg("overlap") - F.lit(25.0) / (F.count("*") - 1), 6).alias("adjusted"))


@query(
    f"WITH {ALL}, {LOW}, ranked AS (SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r FROM p a JOIN p b ON a.id <> b.id), {_knn('l', 'low', 10)}, n AS (SELECT count(*) AS n FROM p) SELECT round(1 - 2.0 / (max(n) * 10 * (2 * max(n) - 31)) * sum(CASE WHEN r > 10 THEN r - 10 ELSE 0 END), 6) AS trustworthiness FROM l JOIN ranked USING (i, j), n"
)
def trustworthiness(spark, sf_dir):
    high = table(spark, sf_dir)
    return nb.trustworthiness(high, nb.knn(table(spark, sf_dir, 1, 8), 10), 10).select(F.round("trustworthiness", 6).alias("trustworthiness"))


@query(f"WITH {ONE}, {TWO}, {_knn('a', 'one', 20)}, {_knn('b', 'two', 20)}, s AS (SELECT a.i, count(b.j) AS c FROM a LEFT JOIN b ON a.i = b.i AND a.j = b.j GROUP BY a.i) SELECT i, round(c / (40.0 - c), 6) AS jaccard FROM s")
def cross_modal_jaccard(spark, sf_dir):
    return nb.jaccard(nb.knn(table(spark, sf_dir, 1, 32), 20), nb.knn(table(spark, sf_dir, 33, 32), 20)).select("i", F.round("jaccard", 6).alias("jaccard"))


_STRATA = "CASE WHEN jaccard >= hi THEN 2 WHEN jaccard <= lo THEN 0 ELSE 1 END"


@query(f"WITH s AS ({ORACLES['cross_modal_jaccard']}), q AS (SELECT quantile_cont(jaccard, 0.25) AS lo, quantile_cont(jaccard, 0.75) AS hi FROM s) SELECT i, jaccard, {_STRATA} AS stratum FROM s, q")
def alignment_score(spark, sf_dir):
    return statistics.strata(cross_modal_jaccard(spark, sf_dir), "jaccard")


_LID = "{0} AS (SELECT i, -count(*) / sum(ln(d / greatest(r, 1e-10) + 1e-10)) AS lid FROM (SELECT *, max(d) OVER (PARTITION BY i) AS r FROM {1}) GROUP BY i)"


@query(f"WITH {ALL}, {_knn('e', 'p', 20)}, {_LID.format('s', 'e')} SELECT i, round(lid, 4) AS lid FROM s")
def local_intrinsic_dimension(spark, sf_dir):
    return nb.intrinsic_dimension(nb.knn(table(spark, sf_dir), 20)).select("i", F.round("lid", 4).alias("lid"))


_AVG_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"


@query(f"WITH {ONE}, {TWO}, {_knn('ea', 'one', 20)}, {_knn('eb', 'two', 20)}, {_LID.format('a', 'ea')}, {_LID.format('b', 'eb')}, r AS (SELECT {_AVG_RANK.format('a.lid')} AS x, {_AVG_RANK.format('b.lid')} AS y FROM a JOIN b USING (i)) SELECT round(corr(x, y), 6) AS spearman FROM r")
def rank_agreement(spark, sf_dir):
    a, b = (nb.intrinsic_dimension(nb.knn(table(spark, sf_dir, f, 32), 20)) for f in (1, 33))
    return statistics.spearman(a.join(b.withColumnRenamed("lid", "other"), "i"), "lid", "other").select(F.round("spearman", 6).alias("spearman"))


_GRID = nb.grid(60)
_IN = f"rank IN ({', '.join(map(str, _GRID))})"


@query(f"WITH {ALL}, {_knn('e', 'p', 60)} SELECT i, round(regr_slope(ln(rank), ln(d)), 4) AS slope, round(regr_r2(ln(rank), ln(d)), 4) AS r2 FROM e WHERE {_IN} GROUP BY i")
def log_log_consistency(spark, sf_dir):
    return nb.log_log(nb.knn(table(spark, sf_dir), 60), _GRID).select("i", F.round("slope", 4).alias("slope"), F.round("r2", 4).alias("r2"))


_KSTAR = f"kstar AS (SELECT i, coalesce(max(CASE WHEN n >= 3 AND syy > 0 AND r2 >= 0.95 THEN rank END), {_GRID[0]}) AS k_star FROM (SELECT i, rank, count(*) OVER w AS n, regr_r2(ln(d), ln(rank)) OVER w AS r2, regr_syy(ln(d), ln(rank)) OVER w AS syy FROM e WHERE {_IN} WINDOW w AS (PARTITION BY i ORDER BY rank ROWS UNBOUNDED PRECEDING)) GROUP BY i)"


@query(f"WITH {ALL}, {_knn('e', 'p', 60)}, {_KSTAR} SELECT i, k_star FROM kstar")
def k_star(spark, sf_dir):
    return nb.k_star(nb.knn(table(spark, sf_dir), 60), _GRID)


_KERNEL = "s AS (SELECT i, max(d) AS s FROM e15 GROUP BY i), w1 AS (SELECT e.i, e.j, exp(-d * d / greatest(a.s * b.s, 1e-20)) AS w FROM e15 e JOIN s a ON e.i = a.i JOIN s b ON e.j = b.i), kern AS (SELECT i, j, max(w) AS w FROM (SELECT * FROM w1 UNION ALL SELECT j, i, w FROM w1) GROUP BY i, j)"
_K15 = f"{ALL}, {_knn('e15', 'p', 15)}, {_KERNEL}"


@query(f"WITH {_K15} SELECT i, j, round(w, 6) AS w FROM kern")
def neighbour_kernel(spark, sf_dir):
    return nb.kernel(nb.knn(table(spark, sf_dir), 15)).select("i", "j", F.round("w", 6).alias("w"))


@query(f"WITH {_K15} SELECT i, j, round(w / sum(w) OVER (PARTITION BY i), 6) AS w FROM kern")
def diffusion_operator(spark, sf_dir):
    return nb.row_normalised(nb.kernel(nb.knn(table(spark, sf_dir), 15))).select("i", "j", F.round("w", 6).alias("w"))


@query(f"WITH {_K15}, s2 AS (SELECT i, sum(w) * sum(w) / sum(w * w) AS k FROM kern GROUP BY i) SELECT round(avg(k), 5) AS mean, round(median(k), 5) AS median, round(stddev_pop(k), 5) AS std, round(min(k), 5) AS min, round(max(k), 5) AS max FROM s2")
def effective_neighborhood_size(spark, sf_dir):
    s = nb.effective_size(nb.kernel(nb.knn(table(spark, sf_dir), 15)))
    r = lambda f, name: F.round(f("k_eff"), 5).alias(name)
    return s.agg(r(F.avg, "mean"), r(F.median, "median"), r(F.stddev_pop, "std"), r(F.min, "min"), r(F.max, "max"))


@query(f"WITH {_K15}, {_knn('e', 'p', 60)}, {_KSTAR}, f AS (SELECT i, sum(w) * sum(w) / sum(w * w) AS k FROM kern GROUP BY i) SELECT i, round(k / k_star, 5) AS ratio FROM f JOIN kstar USING (i)")
def mismatch_ratio(spark, sf_dir):
    edges = materialize(nb.knn(table(spark, sf_dir), 60), "neighbours")  # read to two ranks
    k = nb.effective_size(nb.kernel(edges.where("rank <= 15")))
    return k.join(nb.k_star(edges, _GRID), "i").select("i", F.round(F.col("k_eff") / F.col("k_star"), 5).alias("ratio"))


@query(f"WITH {_K15}, n AS (SELECT count(*) AS n FROM p) SELECT round(1 - count(*) FILTER (WHERE abs(w) > 1e-10) / (max(n)::DOUBLE * max(n)), 6) AS sparsity, round(count(*) FILTER (WHERE abs(w) > 1e-10) / (max(n)::DOUBLE * max(n)), 6) AS density FROM kern, n")
def kernel_sparsity(spark, sf_dir):
    p = table(spark, sf_dir)
    size = p.agg(F.count("*").cast("double").alias("n"))
    share = F.count_if(F.abs("w") > 1e-10) / (F.first("n") * F.first("n"))
    return nb.kernel(nb.knn(p, 15)).crossJoin(F.broadcast(size)).agg(F.round(1 - share, 6).alias("sparsity"), F.round(share, 6).alias("density"))


@query(f"WITH RECURSIVE {ALL}, {_knn('e', 'p', 1)}, g AS (SELECT i, j FROM e UNION SELECT j, i FROM e), walk AS (SELECT id AS node, id AS label FROM p UNION SELECT g.j, walk.label FROM walk JOIN g ON g.i = walk.node) SELECT component, count(*) AS size FROM (SELECT node, min(label) AS component FROM walk GROUP BY node) GROUP BY component")
def connected_components(spark, sf_dir):
    e = nb.knn(table(spark, sf_dir), 1)
    return graph.connected_components(e, "i", "j").groupBy("component").agg(F.count("*").alias("size"))


_LOF = "kd AS (SELECT i, max(d) AS kd FROM e GROUP BY i), lrd AS (SELECT e.i, 1 / (avg(greatest(d, kd)) + 1e-10) AS l FROM e JOIN kd ON e.j = kd.i GROUP BY e.i)"


@query(f"WITH {ALL}, {_knn('e', 'p', 20)}, {_LOF} SELECT e.i, round(avg(b.l) / max(a.l), 5) AS lof FROM e JOIN lrd a ON e.i = a.i JOIN lrd b ON e.j = b.i GROUP BY e.i")
def outlier_score(spark, sf_dir):
    return nb.outlier_factor(nb.knn(table(spark, sf_dir), 20)).select("i", F.round("lof", 5).alias("lof"))


@query(f"WITH {ALL}, {LOW}, {_knn('e', 'p', 15)}, b AS (SELECT e.i, e.d, list_distance(x.v, y.v) AS e FROM e JOIN low x ON e.i = x.id JOIN low y ON e.j = y.id), a AS (SELECT sum(d * e) / sum(d * d) AS a FROM b) SELECT i, round(avg(abs(e - a * d)), 6) AS residual FROM b, a GROUP BY i")
def shepard_residual(spark, sf_dir):
    return nb.shepard_residual(nb.knn(table(spark, sf_dir), 15), table(spark, sf_dir, 1, 8)).select("i", F.round("residual", 6).alias("residual"))


@query()
def local_spectral_analysis(spark, sf_dir):
    """Participation ratio, top share and tangent dimension of every neighbourhood (held against numpy in the tests)."""
    p = table(spark, sf_dir)
    return nb.local_spectrum(nb.knn(p, 25), p).select("i", F.round("participation", 5).alias("participation"), F.round("top", 5).alias("top"), "dimension")


@query(f"WITH {ALL}, {_knn('e', 'p', 5)}, deg AS (SELECT i, count(*) AS deg FROM e GROUP BY i), x AS (SELECT id, v[1] AS x FROM p) SELECT round(sum(a.x * a.x * CASE WHEN e.rank = 1 THEN deg ELSE 0 END) - sum(a.x * b.x), 5) AS smoothness FROM e JOIN deg USING (i) JOIN x a ON e.i = a.id JOIN x b ON e.j = b.id")
def knn_laplacian_smoothness(spark, sf_dir):
    """x'Lx of the first coordinate, with L the degrees minus the directed neighbour graph."""
    p = table(spark, sf_dir)
    x = p.select(F.col("id").alias("i"), F.element_at("vec", 1).alias("x"))
    e = nb.knn(p, 5).join(x, "i").join(x.select(F.col("i").alias("j"), F.col("x").alias("y")), "j")
    return e.agg(F.round(F.sum(F.col("x") * F.col("x") - F.col("x") * F.col("y")), 5).alias("smoothness"))


@query(f"WITH {_K15}, h AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS w FROM kern) SELECT i, j, round(w / 2, 6) AS w FROM (SELECT i, j, sum(w) AS w FROM (SELECT * FROM h UNION ALL SELECT j, i, w FROM h) GROUP BY i, j)")
def symmetrised_graph(spark, sf_dir):
    h = nb.row_normalised(nb.kernel(nb.knn(table(spark, sf_dir), 15)))
    return h.union(h.select("j", "i", "w")).groupBy("i", "j").agg(F.round(F.sum("w") / 2, 6).alias("w"))


# statistics ------------------------------------------------------------------


@query("WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), m AS (SELECT a.id, a.label, b.label AS other, avg(list_distance(a.v, b.v)) AS m FROM p a JOIN p b ON a.id <> b.id GROUP BY ALL), s AS (SELECT id, min(CASE WHEN other = label THEN m END) AS a, min(CASE WHEN other <> label THEN m END) AS b FROM m GROUP BY id, label) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s")
def silhouette(spark, sf_dir):
    labels = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return statistics.silhouette(table(spark, sf_dir), labels).agg(F.round(F.avg("silhouette"), 6).alias("silhouette"))


@query(
    f"WITH x AS (SELECT n_chars, toxic FROM documents JOIN labels USING (doc_id) WHERE toxic IN (0, 1)), r AS (SELECT toxic, {_AVG_RANK.format('n_chars')} AS r FROM x) SELECT round((sum(CASE WHEN toxic = 1 THEN r END) - sum(toxic) * (sum(toxic) + 1) / 2.0) / (sum(toxic) * (count(*) - sum(toxic))), 6) AS auc FROM r"
)
def auc(spark, sf_dir):
    x = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read_table(spark, sf_dir, "labels"), "doc_id")
    return statistics.auc(x, "n_chars", "toxic").select(F.round("auc", 6).alias("auc"))


@query(f"SELECT o_orderkey, round(({_AVG_RANK.format('o_totalprice')} - 1) / (count(*) OVER () - 1), 8) AS pct_rank FROM orders")
def percentile_ranks(spark, sf_dir):
    return statistics.percentile_ranks(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", F.round("pct_rank", 8).alias("pct_rank"))


@query(f"WITH x AS (SELECT {_AVG_RANK.format('l_quantity')} AS a, {_AVG_RANK.format('l_extendedprice')} AS b FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) SELECT round(corr(a, b), 6) AS spearman FROM x")
def metric_agreement(spark, sf_dir):
    return statistics.spearman(read_table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice").select(F.round("spearman", 6).alias("spearman"))


_FRACTAL = """WITH x AS (SELECT vec_id AS id, unnest(range(1, 65)) AS p, unnest(embedding::DOUBLE[]) AS x FROM embeddings), r AS (SELECT p, min(x) AS lo, max(x) - min(x) AS range FROM x GROUP BY p), s AS (SELECT ln(min(range) / 10) AS a, ln(max(range)) AS b FROM r), e AS (SELECT i, exp(a + (b - a) * i / 9) AS eps FROM s, range(10) t(i)), c AS (SELECT e.i, eps, id, string_agg(CAST(CAST(floor((x - lo) / eps) AS BIGINT) AS VARCHAR), ',' ORDER BY x.p) AS cell FROM x JOIN r USING (p), e GROUP BY e.i, eps, id), n AS (SELECT eps, count(DISTINCT cell) AS n FROM c GROUP BY eps) SELECT round(-regr_slope(ln(n), ln(eps)), 4) AS fractal_dimension FROM n"""


@query(_FRACTAL)
def fractal_dimension(spark, sf_dir):
    return statistics.fractal_dimension(table(spark, sf_dir)).select(F.round("fractal_dimension", 4).alias("fractal_dimension"))


@query("WITH g AS (SELECT p1.s_nationkey AS nation, p1.s_suppkey AS a, p2.s_suppkey AS b, abs(p1.s_acctbal - p2.s_acctbal) AS d FROM supplier p1 JOIN supplier p2 ON p1.s_nationkey = p2.s_nationkey AND p1.s_suppkey < p2.s_suppkey) SELECT nation, round(avg(d), 4) AS spread FROM g GROUP BY nation")
def multi_model_spread(spark, sf_dir):
    """Mean pairwise distance within each step."""
    s = read_table(spark, sf_dir, "supplier")
    other = s.select("s_nationkey", F.col("s_suppkey").alias("other"), F.col("s_acctbal").alias("bal"))
    d = s.join(other, "s_nationkey").where("s_suppkey < other")
    return d.groupBy(F.col("s_nationkey").alias("nation")).agg(F.round(F.avg(F.abs(F.col("s_acctbal") - F.col("bal"))), 4).alias("spread"))


@query("WITH s AS (SELECT vec_id, unnest(range(64)) AS c, unnest(embedding::DOUBLE[]) AS x FROM embeddings), l AS (SELECT c AS component, vec_id % 3 AS modality, sqrt(sum(x * x)) AS norm FROM s GROUP BY ALL), f AS (SELECT component, modality, norm / sum(norm) OVER (PARTITION BY component) AS share FROM l) SELECT component, modality, round(share, 6) AS share, min(share) OVER (PARTITION BY component) >= 0.1 AS shared FROM f")
def loadings_analysis(spark, sf_dir):
    long = table(spark, sf_dir).select((F.col("id") % 3).alias("modality"), F.posexplode("vec").alias("component", "loading"))
    return statistics.loadings_summary(long).select("component", "modality", F.round("share", 6).alias("share"), "shared")


# traces ----------------------------------------------------------------------


def _traces(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 7).alias("trace"), F.col("vec_id").alias("step"), F.col("embedding").cast("array<double>").alias("vec"))


_TRACE = "t AS (SELECT vec_id % 7 AS trace, vec_id AS step, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT trace, step, v, lag(v) OVER w AS b, lead(v) OVER w AS a FROM t WINDOW w AS (PARTITION BY trace ORDER BY step)), d AS (SELECT *, list_transform(range(1, 65), lambda i: v[i] - b[i]) AS u, list_transform(range(1, 65), lambda i: a[i] - v[i]) AS x FROM n)"


@query(f"WITH {_TRACE} SELECT trace, step, round(list_distance(v, b), 6) AS velocity, round(1 - list_cosine_similarity(v, b), 6) AS cosine_velocity FROM n")
def trajectory_velocity(spark, sf_dir):
    return statistics.trace_geometry(_traces(spark, sf_dir)).select("trace", "step", F.round("velocity", 6).alias("velocity"), F.round("cosine_velocity", 6).alias("cosine_velocity"))


@query(f"WITH {_TRACE}, c AS (SELECT trace, 2 * sqrt(greatest(1 - power(list_cosine_similarity(u, x), 2), 0)) / greatest(list_distance(a, b), 1e-8) AS c FROM d WHERE a IS NOT NULL AND b IS NOT NULL) SELECT round(avg(m), 6) AS curvature FROM (SELECT trace, avg(c) AS m FROM c GROUP BY trace)")
def trajectory_curvature(spark, sf_dir):
    return statistics.trace_geometry(_traces(spark, sf_dir)).groupBy("trace").agg(F.avg("curvature").alias("m")).agg(F.round(F.avg("m"), 6).alias("curvature"))


_SERIES = "s AS (SELECT CAST(ts AS DATE) AS t, event_type AS gene, sum(value) AS v FROM events GROUP BY ALL), f AS (SELECT t, gene, v - lag(v) OVER (PARTITION BY gene ORDER BY t) AS v FROM s), l AS (SELECT t, gene, v, lag(v) OVER (PARTITION BY gene ORDER BY t) AS past FROM f WHERE v IS NOT NULL), o AS (SELECT * FROM l WHERE past IS NOT NULL)"


@query(
    f"WITH {_SERIES}, j AS (SELECT c.gene AS cause, e.gene AS effect, count(*) AS n, regr_sxx(e.v, e.past) AS xx, regr_sxx(e.v, c.past) AS zz, regr_syy(e.v, e.past) AS yy, regr_sxy(e.v, e.past) AS xy, regr_sxy(e.v, c.past) AS zy, regr_sxy(e.past, c.past) AS xz FROM o e JOIN o c ON e.t = c.t AND e.gene <> c.gene GROUP BY ALL), k AS (SELECT *, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS coef, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b FROM j) SELECT cause, effect, round(coef, 5) AS coef, round(n * ((yy - xy * xy / xx) - (yy - b * xy - coef * zy)) / (yy - b * xy - coef * zy), 4) AS chi2 FROM k"
)
def granger_edges(spark, sf_dir):
    s = read_table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("t"), F.col("event_type").alias("gene")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("gene").orderBy("t")
    diff = s.select("t", "gene", (F.col("v") - F.lag("v").over(w)).alias("value")).where("value is not null")
    return statistics.granger(diff).select("cause", "effect", F.round("coef", 5).alias("coef"), F.round("chi2", 4).alias("chi2"))


# sampling --------------------------------------------------------------------


@query(f"SELECT o_orderkey FROM orders ORDER BY {UNIFORM.format('o_orderkey')}, o_orderkey LIMIT 500")
def random_sampling(spark, sf_dir):
    return sampling.random(read_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500)


@query(
    f"WITH s AS (SELECT c_mktsegment AS g, count(*) AS size FROM customer GROUP BY 1), w AS (SELECT *, CAST(round_even(200.0 * size / sum(size) OVER (), 0) AS BIGINT) AS want FROM s), r AS (SELECT *, 200 - sum(want) OVER () AS rest, row_number() OVER (ORDER BY size DESC, g) AS place FROM w), q AS (SELECT g, want + CASE WHEN place <= abs(rest) THEN sign(rest) ELSE 0 END AS want FROM r), o AS (SELECT c_custkey, c_mktsegment AS g, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {UNIFORM.format('c_custkey')}, c_custkey) AS place FROM customer) SELECT c_custkey, g AS c_mktsegment FROM o JOIN q USING (g) WHERE place <= want"
)
def stratified_sampling(spark, sf_dir):
    return sampling.stratified(read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 200)


@query(f"WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), c AS (SELECT floor(quantile_cont(n, 0.5)) AS cap FROM s), o AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {UNIFORM.format('vec_id')}, vec_id) AS place FROM embeddings) SELECT vec_id, label FROM o, c WHERE place <= cap")
def balanced_sampling(spark, sf_dir):
    return sampling.balanced(read_table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT l_suppkey FROM lineitem)")
def fixed_index_sampling(spark, sf_dir):
    ids = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("vec_id"))
    return sampling.fixed(read_table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", ids)


@query(f"WITH {ALL}, {_knn('e', 'p', 15)}, r AS (SELECT i, max(d) AS w FROM e GROUP BY i), q AS (SELECT quantile_cont(w, 0.99) AS cap, min(w) FILTER (WHERE w > 0) AS least FROM r) SELECT i FROM r, q ORDER BY -ln({UNIFORM.format('i')}) / greatest(least(w, cap), least), i LIMIT 100")
def importance_sampling(spark, sf_dir):
    return sampling.weighted(sampling.importance_weights(nb.knn(table(spark, sf_dir), 15)), "i", "weight", 100).select("i")


@query(f"WITH {ALL}, {_knn('e', 'p', 60)}, {_KSTAR} SELECT i FROM kstar ORDER BY -ln({UNIFORM.format('i')}) / greatest(60 - k_star + 1, 1), i LIMIT 100")
def k_star_sampling(spark, sf_dir):
    k = nb.k_star(nb.knn(table(spark, sf_dir), 60), _GRID)
    return sampling.weighted(k.select("i", F.greatest(60 - F.col("k_star") + 1, F.lit(1)).alias("w")), "i", "w", 100).select("i")


@query(f"WITH {ALL}, {_knn('e', 'p', 60)}, {_KSTAR} SELECT i FROM kstar ORDER BY -ln({UNIFORM.format('i')}) * greatest(15.0 / k_star, 0.001), i LIMIT 100")
def mismatch_aware_sampling(spark, sf_dir):
    k = nb.k_star(nb.knn(table(spark, sf_dir), 60), _GRID)
    return sampling.weighted(k.select("i", (1 / F.greatest(F.lit(15.0) / F.col("k_star"), F.lit(0.001))).alias("w")), "i", "w", 100).select("i")


@query(f"WITH p AS (SELECT vec_id AS id, list_transform((embedding::DOUBLE[])[1:2], lambda x: CAST(floor(x / 0.1) AS BIGINT)) AS cell FROM embeddings), o AS (SELECT id, row_number() OVER (PARTITION BY cell ORDER BY {UNIFORM.format('id')}, id) AS n FROM p) SELECT id FROM o WHERE n <= 2")
def geometric_sketch(spark, sf_dir):
    return sampling.sketch(table(spark, sf_dir, 1, 2), 0.1, 2).select("id")


@query("WITH p AS (SELECT vec_id AS id, (embedding::DOUBLE[])[1:2] AS v FROM embeddings) SELECT id, 0 AS spike FROM p UNION ALL SELECT id, 1 FROM p, range(4) WHERE list_distance(v, [0.0, 0.0]::DOUBLE[]) <= 0.1")
def density_spike(spark, sf_dir):
    return sampling.density_spike(table(spark, sf_dir, 1, 2), [0.0, 0.0], 0.1, 5, noise=0.0).select("id", "spike")


# projection and scalar functions ---------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def flatten_properties(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# merging and sources ---------------------------------------------------------


@query("WITH q AS (SELECT c_custkey AS id, c_acctbal, 'train' AS part FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, c_acctbal, 'test' FROM customer WHERE c_acctbal < 0) SELECT id, part, q.c_acctbal, n_name FROM q JOIN customer c ON q.id = c.c_custkey JOIN nation ON c.c_nationkey = n_nationkey WHERE n_name IS NOT NULL")
def admixture_tables(spark, sf_dir):
    """Two row-aligned tables put under each other, then joined to their metadata."""
    c = read_table(spark, sf_dir, "customer")
    part = lambda rule, name: c.where(rule).select(F.col("c_custkey").alias("id"), "c_acctbal", F.lit(name).alias("part"))
    meta = c.select(F.col("c_custkey").alias("id"), "c_nationkey").join(F.broadcast(read_table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return part("c_acctbal >= 0", "train").unionByName(part("c_acctbal < 0", "test")).join(meta.select("id", "n_name"), "id").na.drop(subset=["n_name"])


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, length(text) AS size FROM conversations WHERE trim(text) <> ''")
def reasoning_trace_steps(spark, sf_dir):
    """Nested traces to one row a step; blank texts dropped."""
    nested = read_table(spark, sf_dir, "conversations").where("trim(text) <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("size")))).alias("steps"))
    return nested.select("conv_id", F.posexplode("steps").alias("step", "s")).select("conv_id", "s.turn", "step", "s.size")


# comparisons -----------------------------------------------------------------

_U = "((CAST('0x' || substr(md5({} || ':{}'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)"
_BOTH = f"{ALL}, {LOW}, c AS (SELECT a.id AS i, b.id AS j, list_distance(a.v, b.v) AS x, list_distance(la.v, lb.v) AS y FROM p a JOIN p b ON a.id < b.id JOIN low la ON la.id = a.id JOIN low lb ON lb.id = b.id)"
_DRAWN = _BOTH + ", s AS (SELECT * FROM c ORDER BY " + _U.format("(i || ',' || j)", 42) + ", i || ',' || j LIMIT {})"
_HSIC = "(sum({0}{1}) - 2.0 / count(*) * sum(r{0} * r{1}) + sum(r{0}) * sum(r{1}) / count(*) / count(*))"


@query(
    f"WITH {ONE}, {TWO}, d AS (SELECT a.id AS i, power(list_distance(a.v, b.v), 2) AS x, power(list_distance(c.v, d.v), 2) AS y FROM one a CROSS JOIN one b JOIN two c ON c.id = a.id JOIN two d ON d.id = b.id), m AS (SELECT median(x) FILTER (WHERE x > 0) AS mx, median(y) FILTER (WHERE y > 0) AS my FROM d), k AS (SELECT i, exp(-x / mx) AS k, exp(-y / my) AS l FROM d, m), r AS (SELECT i, sum(k) AS rk, sum(l) AS rl, sum(k * l) AS kl, sum(k * k) AS kk, sum(l * l) AS ll FROM k GROUP BY i) SELECT round({_HSIC.format('k', 'l')} / sqrt({_HSIC.format('k', 'k')} * {_HSIC.format('l', 'l')}), 6) AS cka FROM r"
)
def cka_rbf(spark, sf_dir):
    return comparison.rbf_cka(table(spark, sf_dir, 1, 32), table(spark, sf_dir, 33, 32)).select(F.round("cka", 6).alias("cka"))


@query(f"WITH {_DRAWN.format(50000)}, f AS (SELECT * FROM s WHERE x >= (SELECT quantile_cont(x, 0.1) FROM s)), r AS (SELECT {_AVG_RANK.format('x')} AS a, {_AVG_RANK.format('y')} AS b FROM f) SELECT round(corr(a, b), 6) AS spearman FROM r")
def ground_truth_preservation(spark, sf_dir):
    return comparison.preservation(table(spark, sf_dir), table(spark, sf_dir, 1, 8), 50_000, only_far=True).select(F.round("spearman", 6).alias("spearman"))


@query(f"WITH {_DRAWN.format(100)} SELECT round(corr(x, y), 6) AS pearson FROM s")
def pearson_correlation(spark, sf_dir):
    return comparison.pearson_distances(table(spark, sf_dir), table(spark, sf_dir, 1, 8)).select(F.round("pearson", 6).alias("pearson"))


@query("WITH o AS (SELECT s_suppkey AS k, s_nationkey AS x, s_acctbal AS y FROM supplier), z AS (SELECT sign(a.x - b.x) AS s, sign(a.y - b.y) AS t FROM o a JOIN o b ON a.k < b.k) SELECT round(sum(s * t) / sqrt(sum(abs(s)) * sum(abs(t))), 6) AS kendall FROM z")
def kendall(spark, sf_dir):
    return comparison.kendall(read_table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal").select(F.round("kendall", 6).alias("kendall"))


@query(
    "WITH x AS (SELECT vec_id AS id, CAST(label >= 5 AS INT) AS side, unnest(range(8)) AS p, unnest((embedding::DOUBLE[])[1:8]) AS x FROM embeddings), w AS (SELECT p, avg(x) FILTER (WHERE side = 1) - avg(x) FILTER (WHERE side = 0) AS w FROM x GROUP BY p), q AS (SELECT id, max(side) AS side, sum(x * w) AS s FROM x JOIN w USING (p) GROUP BY id) SELECT round(avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END), 5) AS auc FROM q a JOIN q b ON a.side = 1 AND b.side = 0"
)
def separation_auroc(spark, sf_dir):
    s = _sides(spark, sf_dir)
    return comparison.separation_auroc(s.select("id", "vec"), s.select("id", "side")).select(F.round("auc", 5).alias("auc"))


@query(
    "WITH n AS (SELECT c_nationkey AS a, c_mktsegment AS b, count(*) AS n FROM customer GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) * (sum(n) - 1) / 2 AS t FROM n), x AS (SELECT sum(m * (m - 1) / 2) AS x FROM (SELECT sum(n) AS m FROM n GROUP BY a)), y AS (SELECT sum(m * (m - 1) / 2) AS y FROM (SELECT sum(n) AS m FROM n GROUP BY b)) SELECT round((s - x * y / t) / ((x + y) / 2 - x * y / t), 8) AS ari FROM s, x, y"
)
def adjusted_rand_index(spark, sf_dir):
    return comparison.adjusted_rand(read_table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment").select(F.round("ari", 8).alias("ari"))


@query()
def kmeans_stratification(spark, sf_dir):
    """ARI of k-means clusters against the labels."""
    labels = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return comparison.adjusted_rand(comparison.kmeans(table(spark, sf_dir), 10).join(labels, "id"), "cluster", "label")


@query()
def pca(spark, sf_dir):
    return comparison.pca(table(spark, sf_dir), 2).select("id", F.posexplode("vec").alias("p", "x"))


_DRAWS = " + ".join(f"CAST(u >= {x!r} AS INT)" for x in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238463, 0.9963401531726564, 0.9994058151824184, 0.9999167588507121, 0.9999897508033254, 0.9999988747974021, 0.9999998885745217, 0.9999999899522336))


@query(
    f"WITH d AS (SELECT s_acctbal AS x, b, {_U.format('(s_suppkey || chr(44) || b)', 42)} AS u FROM supplier, range(100) t(b)), m AS (SELECT b, sum(w * x) / sum(w) AS m FROM (SELECT b, x, {_DRAWS} AS w FROM d) GROUP BY b) SELECT round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM m"
)
def bootstrap_interval(spark, sf_dir):
    return comparison.bootstrap_mean(read_table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal").select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(
    "WITH s AS (SELECT n_nationkey AS step, CAST(floor(sqrt(24 - n_nationkey)) AS BIGINT) AS n FROM nation), r AS (SELECT *, sum(w) OVER (ORDER BY step) AS run FROM (SELECT *, CASE WHEN n = lag(n) OVER (ORDER BY step) THEN 0 ELSE 1 END AS w FROM s)), g AS (SELECT min(step) AS start, count(*) AS length, min(n) AS n FROM r GROUP BY run HAVING count(*) >= 2) SELECT start, length, n, start + length // 2 AS middle, row_number() OVER (ORDER BY length * (1 + start / (SELECT count(*) FROM s)) / greatest(ln(1 + n), 0.1) DESC, start) = 1 AS best FROM g"
)
def stable_scales(spark, sf_dir):
    return comparison.stable_scales(read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("step"), F.floor(F.sqrt(24 - F.col("n_nationkey"))).alias("n")))


# generators and evaluation ---------------------------------------------------


@query(f"WITH r AS (SELECT range AS id, 1.5 * pi() * (1 + 2 * {_U.format('range', 42)}) AS t, 21.0 * {_U.format('range', 43)} AS y FROM range(1000)) SELECT id, round(t * cos(t), 6) AS x, round(y, 6) AS y, round(t * sin(t), 6) AS z FROM r")
def swiss_roll(spark, sf_dir):
    v = synthetic.swiss_roll(spark, 1000)
    return v.select("id", *(F.round(F.col("vec")[i], 6).alias(c) for i, c in enumerate("xyz")))


@query(f"WITH r AS (SELECT range AS id, 2 * pi() * {_U.format('range', 42)} AS a, 2 * pi() * {_U.format('range', 43)} AS b FROM range(1000)) SELECT id, round((2 + 0.5 * cos(b)) * cos(a), 6) AS x, round((2 + 0.5 * cos(b)) * sin(a), 6) AS y, round(0.5 * sin(b), 6) AS z FROM r")
def torus(spark, sf_dir):
    v = synthetic.torus(spark, 1000)
    return v.select("id", *(F.round(F.col("vec")[i], 6).alias(c) for i, c in enumerate("xyz")))


@query(
    f"WITH k AS ({ORACLES['knn_preservation']}), d AS ({ORACLES['pearson_correlation']}), s AS ({ORACLES['shepard_residual']}) SELECT 'knn_preservation' AS metric, round(avg(overlap), 4) AS value FROM k UNION ALL SELECT 'pearson_correlation', round(pearson, 4) FROM d UNION ALL SELECT 'shepard_residual', round(avg(residual), 4) FROM s"
)
def evaluate(spark, sf_dir):
    """Several metrics by name, as one long table."""
    asked = {"knn_preservation": {"k": 10}, "pearson_correlation": {}, "shepard_residual": {"k": 15}}
    return registry.evaluate(table(spark, sf_dir), table(spark, sf_dir, 1, 8), asked).select("metric", F.round("value", 4).alias("value"))


from . import projection_queries, vector_queries  # noqa: E402, F401  these register their queries here
