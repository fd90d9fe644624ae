import zlib

import numpy as np

from manifold_spark.llm import permutation_index as PI
from manifold_spark.llm import toxicity as T


def _exact(ids, x, queries, k=5):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for i in queries:
        s = u @ u[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(PI, "BLOCK", 700)
    monkeypatch.setattr(PI, "CHUNK", 20)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x[2000:2900] = x[2000] + rng.normal(size=(900, 64)).astype(np.float32) * 0.05
    x[2900:] = x[5]
    ids = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), "a", 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, query_id string, rank int").repartition(4)
    want = _exact(ids, x.astype(float), np.flatnonzero(ids % 50 == 0))
    got: dict = {}
    for r in PI.search(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys()
    hits = total = 0
    for q, near in want.items():
        hits += len({v for v, _ in near} & {v for v, _ in got[q]})
        total += len(near)
        exact = {v: s for v, s in _exact(ids, x.astype(float), [int(np.flatnonzero(ids == q)[0])], 3000)[q]}
        assert all(abs(exact[v] - s) < 1e-9 for v, s in got[q])
    assert hits >= 0.9 * total, hits / total


def test_bad_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 2.0]), (9, []), (10, [1.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in PI.search(df, "vec_id % 50 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 3), (0, 3, 50), (50, 1, 3), (50, 2, 3), (50, 3, 0)]
    assert PI.search(df.limit(0), "vec_id % 50 = 0").count() == 0


def _toxic_corpus(n=400):
    rng = np.random.default_rng(5)
    syllables = ["an", "the", "er", "on", "re", "in", "ed", "sh"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.integers(20, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.integers(3, 7)):
                words[rng.integers(len(words))] = rng.choice(["idiotic", "worthless", "scumbag"])
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def test_toxicity_held_out_accuracy(spark):
    docs, labels = _toxic_corpus()
    extra = [(1000, None), (1001, ""), (None, "an the"), (1002, "an the idi0tic er on worthles in scumbagg worthlesss idiotic"), (0, docs[0][1])]
    d = spark.createDataFrame([(*r, 0.5) for r in docs + extra], "doc_id long, text string, score double").repartition(3)
    lab = spark.createDataFrame([*labels, (2, None), (5000, 1), (None, 1)], "doc_id long, toxic int")
    got = T.classify(d, lab).collect()
    assert len(got) == len(docs) + len(extra)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].predicted == by_id[1001].predicted == 0 and by_id[1002].predicted == 1


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in T.classify(d, none).collect()] == [0, 0]
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert [r.predicted for r in T.classify(d, one).collect()] == [0, 0]
    assert T.classify(d.limit(0), one).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    """Many equal vectors in several tasks: equal scores to the last bit, and the smallest ids."""
    rng = np.random.default_rng(11)
    distinct = rng.normal(size=(9, 64)).astype(np.float32).astype(float)
    which = rng.integers(0, 9, 700)
    df = spark.createDataFrame([(int(i), [float(c) for c in distinct[w]]) for i, w in enumerate(which)], "vec_id long, embedding array<double>").repartition(5)
    unit = distinct / np.sqrt((distinct**2).sum(1, keepdims=True))
    got = PI.search(df, "vec_id % 50 = 0").collect()
    for q in range(0, 700, 50):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        near = np.argsort(-(unit @ unit[which[q]]), kind="stable")
        want = [int(i) for w in near for i in np.flatnonzero(which == w) if i != q][:5]
        assert [r.vec_id for r in mine] == want
