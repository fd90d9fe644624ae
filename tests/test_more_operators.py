import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from manifold_spark.functions import registry, runs
from manifold_spark.operators import clustering, sampling, spectral, statistics, vectors
from manifold_spark.operators import comparison as cmp
from manifold_spark.operators import neighbours as nb
from manifold_spark.sources import files, sinks, synthetic


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(range(len(x)) if ids is None else ids, x, strict=True)], "id long, vec array<double>")


def brute_knn(x, ids, k):
    out = {}
    for a, i in enumerate(ids):
        d = np.sqrt(((x - x[a]) ** 2).sum(1))
        out[i] = [int(ids[b]) for b in np.lexsort((ids, d)) if ids[b] != i][:k]
    return out


def got_knn(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.i, r["rank"])):
        out.setdefault(r.i, []).append(r.j)
    return out


def test_knn_of_many_equal_points_and_far_from_the_origin(spark):
    rng = np.random.default_rng(0)
    copies = np.repeat(rng.normal(size=(3, 8)), 60, axis=0)
    ids = rng.permutation(len(copies))
    assert got_knn(nb.knn(frame(spark, copies, ids), 3, tile=50)) == brute_knn(copies, ids, 3)
    far = 1e5 + 1e-3 * rng.normal(size=(150, 8))
    assert got_knn(nb.knn(frame(spark, far), 5, tile=40)) == brute_knn(far, np.arange(150), 5)


def test_knn_leaves_bad_vectors_out(spark):
    rows = [(0, [0.0]), (1, [1.0]), (2, None), (3, [float("nan")]), (4, [None]), (None, [2.0]), (5, [5.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    assert got_knn(nb.knn(df, 9)) == {0: [1, 5], 1: [0, 5], 5: [1, 0]}
    other = frame(spark, np.array([[0.2], [7.0]]), [0, 1])
    assert [(r.i, r.j) for r in nb.nearest_of(df, other, 1).orderBy("i").collect()] == [(0, 0), (1, 0), (5, 1)]


def test_ranks_moments_and_silhouette(spark):
    rng = np.random.default_rng(1)
    values = [None, None, *(float(v) for v in rng.integers(0, 7, 60))]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v double").repartition(3)
    got = {r.k: r["rank"] for r in statistics.with_average_rank(df, "v").collect()}
    key = [-1e9 if v is None else v for v in values]
    assert got == {i: sum(o < v for o in key) + (sum(o == v for o in key) + 1) / 2 for i, v in enumerate(key)}
    x = 1e4 + rng.normal(size=(40, 3))
    g = {(r.p, r.q): r.c for r in statistics.gram(frame(spark, x).repartition(3)).collect()}
    z = x - x.mean(0)
    assert np.allclose([[g[p, q] for q in range(3)] for p in range(3)], z.T @ z, rtol=1e-6)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "id long, label int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = {r.id: r.silhouette for r in statistics.silhouette(frame(spark, x), labels, tile=15).collect()}
    for i in (0, 7, 39):
        own = [d[i, j] for j in range(40) if j % 2 == i % 2 and j != i]
        a, b = np.mean(own), np.mean([d[i, j] for j in range(40) if j % 2 != i % 2])
        assert s[i] == pytest.approx((b - a) / max(a, b), abs=1e-6)


def dense(edges, n):
    m = np.zeros((n, n))
    for r in edges.collect():
        m[r.i, r.j] = r.w
    return m


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(20, 3)), rng.normal(size=(20, 3)) + 6])
    return x, frame(spark, x)


def test_spectrum_equals_numpy(spark, cloud):
    _, table = cloud
    op = spectral.materialize(spectral.symmetric_operator(spectral.gaussian_edges(table, 8)), "op")
    m = dense(op, 40)
    assert np.allclose(m, m.T)
    want = np.sort(np.linalg.eigvalsh(m))
    want = want[np.argsort(-np.abs(want))][:4]
    whole, whole_vectors = spectral.eigen(op, 4)
    values, vectors_ = spectral.eigen(op, 4, rounds=40, small=0)
    assert np.allclose(whole, values, atol=1e-8)
    # two components: only the space of the two largest is the same
    one, two = (np.array([r.x for r in v.orderBy("id").collect()]) for v in (whole_vectors, vectors_))
    assert np.allclose(one @ one.T, two @ two.T, atol=1e-5)
    assert len(spectral.eigen(op.limit(0), 4)[0]) == 0
    assert np.allclose(values, np.sort(want)[::-1], atol=1e-6)
    x = np.array([r.x for r in vectors_.orderBy("id").collect()])
    assert np.allclose(m @ x[:, 0], values[0] * x[:, 0], atol=1e-3)
    v = spark.createDataFrame([(0, 4.0), (1, 2.0), (2, 1.0), (3, 0.0)], "place int, value double")
    assert spectral.gap_ratio(v).first()[0] == 2
    assert spectral.decay_rate(v).first()[0] == pytest.approx(math.log(2))
    p = np.array([4.0, 2, 1]) ** 3 / 73
    assert spectral.spectral_entropy(v, 3).first()[0] == pytest.approx(-(p * np.log2(p)).sum())
    assert {r.t: r.n for r in spectral.spectral_counts(v, [1, 2], 1.5).collect()} == {1: 2, 2: 2}
    assert spectral.topology(table, v).first().n == 40
    p2 = dense(spectral.power(op, 2), 40)
    assert np.allclose(p2, m @ m)


def test_geodesics_equal_floyd(spark, cloud):
    x, table = cloud
    near = brute_knn(x, np.arange(40), 4)
    d = np.full((40, 40), np.inf)
    np.fill_diagonal(d, 0)
    for i, js in near.items():
        for j in js:
            d[i, j] = d[j, i] = np.linalg.norm(x[i] - x[j])
    for m in range(40):
        d = np.minimum(d, d[:, m : m + 1] + d[m : m + 1, :])
    got = spectral.geodesic_distances(table, 4, spark.createDataFrame([(0,), (33,)], "id long")).collect()
    assert len(got) == np.isfinite(d[[0, 33]]).sum()
    assert all(r.d == pytest.approx(d[r.source, r.id]) for r in got)


def test_spanning_tree_persistence_and_components(spark, cloud):
    x, table = cloud
    edges = nb.pair_distances(table)
    bars = sorted(r.d for r in clustering.spanning_edges(edges).collect())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    inside, want = {0}, []
    while len(inside) < 40:
        a, b = min(((i, j) for i in inside for j in range(40) if j not in inside), key=lambda e: d[e])
        want.append(d[a, b])
        inside.add(b)
    assert np.allclose(bars, sorted(want))
    assert clustering.components_persistence(edges, 0.5, relative=True).first().bars == sum(b > 0.5 * max(want) for b in want)


def test_communities_farthest_points_and_reeb(spark, cloud):
    x, table = cloud
    e = nb.knn(table, 6).select("i", "j", F.lit(1.0).alias("w"))
    both = e.union(e.select("j", "i", "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))
    label = clustering.communities(both)
    of = {r.node: r.community for r in label.collect()}
    assert len(of) == 40 and not {of[i] for i in range(20)} & {of[i] for i in range(20, 40)}
    whole = label.withColumn("community", F.lit(0))
    assert clustering.modularity(both, label).first()[0] > clustering.modularity(both, whole).first()[0] == pytest.approx(0)
    got = clustering.farthest_points(table, 12).orderBy("place").collect()
    d = np.full(40, np.inf)
    for a, b in zip(got, got[1:], strict=False):
        d = np.minimum(d, np.sqrt(((x - x[a.id]) ** 2).sum(1)))
        assert d[b.id] == pytest.approx(d.max())
    assert clustering.farthest_points(table, 99).count() == 40
    ring = [(i, [math.cos(i / 30 * 2 * math.pi), math.sin(i / 30 * 2 * math.pi)]) for i in range(30)]
    ring = spark.createDataFrame(ring, "id long, vec array<double>")
    nodes, links, _ = clustering.reeb_graph(ring.select("id", F.get("vec", F.lit(0)).alias("lens")), nb.knn(ring, 2), bins=4, overlap=0.3)
    assert clustering.graph_summary(nodes, links).first().loops == 1


def test_communities_are_connected(spark):
    rng = np.random.default_rng(5)
    drawn = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 60, (90, 2)).tolist() if a != b}
    edges = spark.createDataFrame([(a, b, float(w)) for (a, b), w in zip(sorted(drawn), rng.uniform(0.2, 3, len(drawn)), strict=True)], "i long, j long, w double")
    # one round only: nodes leave communities that then fall apart
    for rounds in (1, 6):
        of = {r.node: r.community for r in clustering.communities(edges, resolution=0.2, rounds=rounds, levels=3).collect()}
        assert set(of) == {x for e in drawn for x in e}
        part = {x: x for x in of}
        for _ in of:
            for a, b in drawn:
                if of[a] == of[b]:
                    part[a] = part[b] = min(part[a], part[b])
        assert part == of
    assert clustering.communities(edges.limit(0)).count() == 0


def test_classifier_and_layers(spark):
    made = synthetic.cohort(spark, 40, 6, ("rna", "methyl"), ("rna",))
    for layer, good in (("rna", True), ("methyl", False)):
        t = made.where(F.col("layer") == layer)
        labels = t.select("id", "label")
        auc = cmp.separation_auroc(t.select("id", "vec"), labels.withColumnRenamed("label", "side"), 5).first()[0]
        assert (auc > 0.9) == good
        p = clustering.classifier(t.select("id", "vec"), labels).join(labels, "id").collect()
        assert (np.mean([(r.probability > 0.5) == (r.label == 1) for r in p]) > 0.9) == good


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(12, 4)), rng.normal(size=(12, 4))
    a, b = frame(spark, x), frame(spark, y)
    assert vectors.mean_squared_error(a, b).first().mse == pytest.approx(((x - y) ** 2).mean())
    scaled = np.array([r.vec for r in vectors.min_max(a).orderBy("id").collect()])
    assert np.allclose(scaled, (x - x.min(0)) / (x.max(0) - x.min(0)))
    every = np.concatenate([x, y])
    d2 = ((every[:, None] - every[None]) ** 2).sum(-1)
    width = d2.sum() / (24 * 24 - 24) / 2.0**2
    k = sum(np.exp(-d2 / (width * 2.0**i)) for i in range(5))
    assert vectors.discrepancy(a, b).first().mmd == pytest.approx(k[:12, :12].mean() + k[12:, 12:].mean() - 2 * k[:12, 12:].mean())
    h = np.eye(12) - 1 / 12
    g = h @ (x @ x.T) @ h
    assert all(r.c == pytest.approx(g[r.i, r.j]) for r in vectors.center_gram(a).collect())
    geno = np.array([[0, 2], [1, -1], [2, 2], [1, 0]], float)
    f = np.where(geno == -1, np.nan, geno)
    p = np.nanmean(f / 2, axis=0)
    want = np.nan_to_num((f - 2 * p) / np.sqrt(2 * p * (1 - p)))
    assert np.allclose([r.vec for r in vectors.genotypes(frame(spark, geno)).orderBy("id").collect()], want)
    assert [r.vec for r in vectors.merge({"a": a, "b": b}).orderBy("id").collect()] == [[*p, *q] for p, q in zip(x.tolist(), y.tolist(), strict=True)]
    mixed = vectors.merge({"a": a, "b": b}, "weighted_sum", {"a": 0.7, "b": 0.3}).orderBy("id").collect()
    assert np.allclose([r.vec for r in mixed], 0.7 * x + 0.3 * y)
    low, loadings = vectors.svd(a, 2)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs([r.vec for r in low.orderBy("id").collect()]), np.abs(u[:, :2] * s[:2]))
    shares = vectors.channel_shares(loadings, {"one": 1, "rest": 3}).groupBy("component").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in shares)
    e = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 1, 1.0)], "i long, j long, w double")
    o = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "i long, j long, w double")
    assert {(r.i, r.j): r.w for r in vectors.merge_operators([e, o]).collect()} == {(0, 0): 0.25, (0, 1): 0.75, (1, 1): 0.5, (1, 0): 0.5}
    assert vectors.operator_distance(e, o).first()[0] == pytest.approx(math.sqrt(0.25 + 0.25 + 1 + 1))


def test_alignment_and_pooling(spark):
    steps = lambda n, f: spark.createDataFrame([(0, i, [f(i), 1.0]) for i in range(n)], "trace long, step long, vec array<double>")
    a, b = steps(9, lambda i: float(i)), steps(5, lambda i: 2.0 * i)
    got = vectors.align(a, b, "resample").orderBy("step").collect()
    assert [r.a[0] for r in got] == [0, 2, 4, 6, 8] and all(abs(r.residual) < 1e-9 for r in got)
    assert vectors.align(a, b).count() == 5
    t = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, 6.0])], "sample_id long, position int, vec array<double>")
    assert {h: vectors.pool(t, h).first().vec for h in ("mean", "cls", "last_token", "all")} == {"mean": [2, 4], "cls": [1, 2], "last_token": [3, 6], "all": [1, 2, 3, 6]}


def test_generators(spark):
    s = synthetic.get_dataset(spark, "Saddle", n=50).collect()
    assert all(r.vec[2] == pytest.approx(r.u**2 - r.v**2) for r in s)
    a = np.array([r.weights for r in synthetic.archetypal(spark, 300).collect()])
    assert np.allclose(a.sum(1), 1) and np.allclose(a.mean(0), 1 / 3, atol=0.08) and (a.max(1) > 0.9).mean() > 0.2
    t = synthetic.tree(spark, [20, 10, 15], gaps=[2], jump=5.0)
    assert t.count() == 45 and t.select("branch").distinct().count() == 3
    g = synthetic.tree_from_graph(spark, [(0, 1, 5), (1, 2, 6), (1, 3, 7)], [(1, 2)])
    assert g.count() == 12
    roll = synthetic.swiss_roll(spark, 60)
    assert synthetic.without_gaps(roll, "t", 2, 0.4).count() < 60
    turned = np.array([r.vec for r in synthetic.rotated(roll, 6).orderBy("id").collect()])
    flat = np.array([r.vec for r in roll.orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(turned[0] - turned[1:], axis=1), np.linalg.norm(flat[0] - flat[1:], axis=1))
    assert synthetic.list_datasets() == sorted(synthetic.DATASETS)
    with pytest.raises(KeyError):
        synthetic.get_dataset(spark, "nothing")
    one = synthetic.noisy(roll, 0.1, 3).collect()
    assert one == synthetic.noisy(roll.repartition(5), 0.1, 3).orderBy("id").collect()
    assert sampling.sample_size(10, fraction=0.35) == 3 and sampling.sample_size(10, 20) == 10


def test_files_and_sinks(spark, tmp_path):
    x = np.arange(12.0).reshape(6, 2)
    np.save(tmp_path / "emb_one.npy", x)
    np.save(tmp_path / "emb_two.npy", x + 1)
    np.savez(tmp_path / "t0.npz", pooled_steps=np.arange(24.0).reshape(3, 2, 4))
    (tmp_path / "p.csv").write_text("a;b; kind\n" + "".join(f"{i};{i * 2};{'x' if i == 1 else i}\n" for i in range(5)))
    assert [r.vec for r in files.read_precomputed(spark, str(tmp_path / "emb_one.npy")).orderBy("id").collect()] == x.tolist()
    both = files.read_directory(spark, str(tmp_path))
    assert {r.channel for r in both.select("channel").distinct().collect()} == {"one", "two"}
    channels = {c: both.where(F.col("channel") == c).select("id", "vec") for c in ("one", "two")}
    assert files.join_channels(channels).where("id = 2").first().vec == [4, 5, 5, 6]
    with pytest.raises(ValueError):
        files.join_channels({"one": channels["one"], "two": channels["two"].where("id < 3")})
    csv = files.read_csv_points(spark, str(tmp_path / "p.csv"), "kind").orderBy("id").collect()
    assert [(r.id, r.vec, r.label) for r in csv][:2] == [(0, [0, 0], 0), (1, [1, 2], 0)]
    assert files.detect_separator(spark, str(tmp_path / "p.csv")) == ";"
    with pytest.raises(ValueError):
        files.load_metadata(spark, str(tmp_path / "p.csv"), ["missing"])
    traces = files.read_npz_traces(spark, str(tmp_path / "*.npz")).orderBy("step").collect()
    assert [r.vec for r in traces] == np.arange(24.0).reshape(3, 2, 4)[:, -1].tolist()
    points = frame(spark, x)
    train, test = files.split(points, 0.34)
    assert test.count() == 2 and train.count() == 4
    (tmp_path / "t.jsonl").write_text('{"text": "a b"}\n{"text": " "}\n{"text": "c"}\n')
    rows = files.read_text_rows(spark, str(tmp_path / "t.jsonl"))
    assert rows.count() == 2 and files.points_column(points) == "vec"
    ids = files.tokenized(rows, lambda texts: [[len(w) for w in t.split()] for t in texts], 3).collect()
    assert sorted((r.input_ids, r.attention_mask) for r in ids) == [([1, 0, 0], [1, 0, 0]), ([1, 1, 0], [1, 1, 0])]
    for format in ("parquet", "csv", "json"):
        sinks.write_outputs({"embeddings": points, "graph": nb.knn(points, 2)}, str(tmp_path / format), format, {"lid": 2.0})
        tables, said = sinks.load_outputs(spark, str(tmp_path / format))
        assert [r.vec for r in tables["embeddings"].orderBy("id").collect()] == x.tolist()
        assert said["shape"] == [6, 2] and said["scores"] == {"lid": 2.0} and tables["graph"].count() == 12
    for step in (0, 1, 1):
        sinks.write_step(points, str(tmp_path / "steps"), step, f"s{step}")
    assert spark.read.parquet(str(tmp_path / "steps")).count() == 12
    scores, per = sinks.score_tables(sinks.results_table(spark, {"a": 1.0, "b": 2.0}), {"c": points.select("id", F.lit(3.0).alias("value")).where("id < 2")}, points)
    assert scores.first().asDict() == {"a": 1.0, "b": 2.0} and per.where("c is null").count() == 4
    with pytest.raises(ValueError):
        sinks.snapshot(spark.createDataFrame([(1, "a", [1.0]), (1, "a", [2.0])], "sample_id long, layer string, vec array<double>"))


def test_runs(spark, tmp_path):
    for run, text in (("r1", "trust: 0.5 lid: array([1.0, 2.5])"), ("r2", "trust=1e-1")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "x.log").write_text(text)
    got = {(r.run, r.metric): r.value for r in runs.load_runs(spark, [str(tmp_path)], ["trust", "lid"]).collect()}
    assert got == {("r1", "trust"): 0.5, ("r1", "lid_2"): 1.0, ("r1", "lid_3"): 2.5, ("r2", "trust"): 0.1}
    assert runs.flat_settings({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a.b": 1, "a.c.d": 2, "e": 3}
    assert runs.unrolled({"lid": {"k": [5, 10]}, "cka": {}}) == {"lid__k_5": ("lid", {"k": 5}), "lid__k_10": ("lid", {"k": 10}), "cka": ("cka", {})}
    nested = spark.sql("select named_struct('b', 1, 'c', named_struct('d', 2)) as a, 3 as e")
    assert runs.flattened(nested).columns == ["a.b", "a.c.d", "e"]
    scores = spark.createDataFrame([("lid__k_5", 1.0), ("lid__k_10", 2.0), ("cka", 3.0)], "metric string, value double")
    assert sorted((r.metric, r.k, r.value) for r in runs.curves(scores).collect()) == [("lid", 5, 1.0), ("lid", 10, 2.0)]
    assert "run.seed" in runs.with_settings(scores, {"run": {"seed": 1}}, ["run"]).columns


def test_evaluate_by_name(spark, cloud):
    x, table = cloud
    low = frame(spark, x[:, :2])
    labels = spark.createDataFrame([(i, i // 20) for i in range(40)], "id long, label int")
    got = {r.metric: r.value for r in registry.evaluate(table, low, {"knn_preservation": {"k": [3, 5]}, "lid": {"k": 5}, "silhouette": {}, "NoOp": {}}, labels).collect()}
    assert got.keys() == {"knn_preservation__k_3", "knn_preservation__k_5", "lid", "silhouette", "NoOp"}
    a, b = brute_knn(x, np.arange(40), 3), brute_knn(x[:, :2], np.arange(40), 3)
    assert got["knn_preservation__k_3"] == pytest.approx(np.mean([len(set(a[i]) & set(b[i])) / 3 for i in a]))
    value, per = registry.evaluate_detailed(table, low, "lid", k=5)
    assert value.first().value == pytest.approx(got["lid"]) and per.count() == 40
    with pytest.raises(KeyError):
        registry.evaluate(table, low, ["nothing"])
    half = registry.evaluate(table, low, ["NoOp"], sample=lambda t: sampling.random(t, "id", 10))
    assert half.count() == 1


def laplacian(edges, n):
    a = np.zeros((n, n))
    for r in edges.collect():
        a[r.i, r.j] = 1
    return np.diag(a.sum(1)) - a, a.sum(1)


def test_smoothness_equals_the_laplacian(spark, cloud):
    x, table = cloud
    n = len(x)
    edges = nb.knn(table, 4).select("i", "j")
    lap, deg = laplacian(edges, n)
    got = spectral.smoothness(edges, table, normalised=False).first()["smoothness"]
    assert math.isclose(got, np.trace(x.T @ lap @ x) / x.shape[1], rel_tol=1e-9)
    half = np.diag(deg**-0.5)
    got = spectral.smoothness(edges, table).first()["smoothness"]
    assert math.isclose(got, np.trace(x.T @ half @ lap @ half @ x) / x.shape[1], rel_tol=1e-9)


def test_curvature_equals_dense_powers(spark, cloud):
    x, table = cloud
    edges = spectral.gaussian_edges(table, 4)
    w = dense(edges, len(x))
    p = w / w.sum(1, keepdims=True)
    power = np.linalg.matrix_power(p, 2)
    reached = (power @ power.T) > 0
    d = np.sqrt(np.maximum(((power[:, None] - power[None]) ** 2).sum(-1), 0))
    cut = np.sort(d[reached])[max(math.ceil(0.3 * reached.sum()) - 1, 0)]
    ball = reached & (d <= cut + 1e-12)
    got = {r.i: r.curvature for r in spectral.diffusion_curvature(spectral.row_shares(edges), t=2, percentile=0.3).collect()}
    want = {i: power[i][ball[i]].mean() for i in range(len(x))}
    assert got.keys() == want.keys()
    assert np.allclose([got[i] for i in want], list(want.values()), atol=1e-6)


def test_admixture_tables(spark, tmp_path):
    (tmp_path / "train.txt").write_text("a\nb\nc\n")
    (tmp_path / "test.txt").write_text("d\n")
    for k in (2, 3):
        for name, rows in (("train", 3), ("test", 1)):
            (tmp_path / f"{name}.{k}.Q").write_text("".join(" ".join([f"0.{r + 1}"] * k) + "\n" for r in range(rows)))
    metadata = spark.createDataFrame([("a", "x"), ("b", None), ("d", "y"), ("e", "z")], "ID string, population string")
    got = files.admixture(spark, str(tmp_path), f"{tmp_path}/train.txt", f"{tmp_path}/test.txt", metadata, range(2, 4), "train", "test")
    rows = sorted((r.k, r.ID, r.population, tuple(r.q)) for r in got.collect())
    assert rows == [(k, i, p, (v,) * k) for k in (2, 3) for i, p, v in (("a", "x", 0.1), ("d", "y", 0.1))]


def dense_condensation(x, p, scale, granularity, rounds):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(len(x), 1)]
    threshold, group, counts = np.percentile(d, 0.1) + granularity * d.std() * 0.1, np.arange(len(x)), [len(x)]
    for _ in range(rounds):
        names = np.unique(group)
        if len(names) <= 1:
            break
        c = np.array([x[group == g].mean(0) for g in names])
        near = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1)) < threshold
        np.fill_diagonal(near, False)
        if not near.any():
            x, threshold = p @ x, threshold * scale
        else:
            label = names.copy()
            while True:
                new = np.array([min([label[i], *label[near[i]]]) for i in range(len(names))])
                if (new == label).all():
                    break
                label = new
            group = label[np.searchsorted(names, group)]
        counts.append(len(np.unique(group)))
    return counts, group


def test_condensation_equals_numpy(spark):
    x = np.concatenate([np.random.default_rng(5).normal(c, 0.3, size=(8, 2)) for c in (0, 3)])
    table = frame(spark, x)
    operator = spectral.materialize(spectral.row_shares(spectral.decay_edges(table, 3)), "operator")
    p = dense(operator, 16)
    want, group = dense_condensation(x, p, 1.3, 0.1, 9)
    steps, groups = spectral.condensation(table, operator, scale=1.3, rounds=9)
    assert [r.n for r in steps.orderBy("step").collect()] == want and want[-1] < 16
    assert [r.group for r in groups.orderBy("id").collect()] == group.tolist()
    assert spectral.condense(table.limit(0)).collect() == [] and [tuple(r) for r in spectral.condense(table.limit(1)).collect()] == [(0, 1)]


def test_reeb_graph_links_by_edges(spark):
    from manifold_spark.operators import clustering

    path = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, lens double")
    steps = spark.createDataFrame([(i, i + 1) for i in range(19)], "i long, j long")
    for overlap in (0.0, 0.3):
        nodes, links, members = clustering.reeb_graph(path, steps, 4, overlap)
        got = clustering.graph_summary(nodes, links).first()
        assert (got.nodes, got.edges, got.components, got.loops, got.branch_points, got.endpoints) == (4, 3, 1, 0, 0, 2)
    assert members.count() > 20
    # components of at most a tenth of the mean number of points of a bin go
    lone = path.union(spark.createDataFrame([(99, 7.0)], path.schema))
    assert clustering.reeb_graph(lone, steps, 2, density_factor=0.1)[0].count() == 2
    assert clustering.reeb_graph(lone, steps, 2, density_factor=0.0)[0].count() == 3
    empty, none, _ = clustering.reeb_graph(path.limit(0), steps)
    assert clustering.graph_summary(empty, none).first().nodes == 0
    for lens in ("density", "pca1", "diffusion1"):
        points = frame(spark, np.random.default_rng(1).normal(size=(30, 3)))
        assert clustering.lens_values(points, lens, 5).count() == 30
    with pytest.raises(ValueError, match="no lens"):
        clustering.lens_values(path, "x")


def test_granger_scores(spark):
    from manifold_spark.operators import statistics

    rng = np.random.default_rng(3)
    a = np.cumsum(rng.normal(size=80))
    b = np.concatenate([[0.0], np.cumsum(np.diff(a) * 0.9 + rng.normal(size=79) * 0.1)])
    b = np.concatenate([[0.0], b[:-1]])
    rows = [(t, g, cell, float(v[t] + cell)) for t in range(80) for g, v in (("a", a), ("b", b)) for cell in (-1, 1)] + [(t, "flat", 0, 1.0) for t in range(80)]
    got = {(r.cause, r.effect): r for r in statistics.granger_scores(spark.createDataFrame(rows, "t int, gene string, cell int, value double"), downsample=1).collect()}
    assert set(got) == {("a", "b"), ("b", "a")}
    y, x, z = np.diff(b)[1:], np.diff(b)[:-1], np.diff(a)[:-1]
    fit = lambda *c: np.linalg.lstsq(np.stack([*c, np.ones(len(y))], 1), y, rcond=None)
    full, own = fit(x, z), fit(x)
    chi2 = len(y) * (own[1][0] - full[1][0]) / full[1][0]
    p = math.erfc(math.sqrt(chi2 / 2))
    assert got["a", "b"].coef == pytest.approx(full[0][1]) and got["a", "b"].p == pytest.approx(p, abs=1e-12)
    assert got["a", "b"].score == pytest.approx(-math.log(p + 2.0**-10)) and got["a", "b"].score > 6
    assert statistics.gene_series(spark.createDataFrame(rows, "t int, gene string, cell int, value double"), 10).count() == 7 * 3


def test_strata_equal_an_order_of_all_rows(spark):
    from pyspark.sql import functions as F

    from manifold_spark.operators import sampling

    strata = ["hot"] * 700 + ["b"] * 200 + ["c"] * 60 + [None] * 40
    df = spark.createDataFrame([(i, g, -1, "x") for i, g in enumerate(strata)], "id long, g string, place int, slice string").repartition(5)
    ranked = [(r.g, r.u, r.id) for r in df.select("id", "g", sampling.uniform("id", 7).alias("u")).collect()]
    first = lambda g, n: {i for _, _, i in sorted(r for r in ranked if r[0] == g)[:n]}
    got = sampling.stratified(df, "id", "g", 100, seed=7)
    assert got.columns == df.columns
    assert {r.id for r in got.collect()} == first("hot", 70) | first("b", 20) | first("c", 6) | {i for _, i in sorted((u, i) for g, u, i in ranked if g is None)[:4]}
    sizes = {r.g: r.n for r in sampling.balanced(df, "id", "g", seed=7).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"hot": 130, "b": 130, "c": 60, None: 40}
    assert sampling.stratified(df.limit(0), "id", "g", 100).count() == 0 == sampling.balanced(df.limit(0), "id", "g").count()
