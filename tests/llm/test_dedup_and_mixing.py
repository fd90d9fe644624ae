import random
from collections import Counter, defaultdict

import pytest

from manifold_spark.llm import line_dedup, mixing, suffix_dedup


def brute_repeats(rows, min_words):
    places = defaultdict(list)
    texts = {}
    for n, (doc_id, text) in enumerate(rows):
        words = (text or "").split()
        texts[n] = words
        for p in range(len(words) - min_words + 1):
            places[tuple(words[p : p + min_words])].append((doc_id, p, n))
    cover, later = defaultdict(set), defaultdict(set)
    for where in places.values():
        if len(where) > 1:
            first = min(where)
            for doc_id, p, n in where:
                cover[doc_id].update(range(p, p + min_words))
                if (doc_id, p) != first[:2]:
                    later[doc_id].update(range(p, p + min_words))
    out = []
    for doc_id, c in cover.items():
        start = None
        for i in sorted(c):
            if i - 1 not in c:
                start = i
            if i + 1 not in c:
                out.append((doc_id, start, i + 1, len(later[doc_id] & set(range(start, i + 1)))))
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_repeats_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(50)}"
    passages = [[word() for _ in range(rng.choice([11, 12, 13, 20, 40]))] for _ in range(5)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randrange(3, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(4)
            at = rng.randrange(len(words))
            words[at:at] = p[cut : len(p) - rng.randrange(3)]
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, "a " * 40), (103, rows[7][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(4)
    got = sorted((r.doc_id, r.start_word, r.end_word, r.n_later_words) for r in suffix_dedup.repeats(docs, min_words=12, w=4).collect())
    assert got == brute_repeats(rows, 12)


def test_repeats_null_ids_and_empty(spark):
    text = " ".join(f"x{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (3, text), (3, text)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.start_word, r.end_word, r.n_later_words) for r in suffix_dedup.repeats(docs).collect())
    assert got == [(-1, 0, 60, 0), (3, 0, 60, 60)]
    assert suffix_dedup.repeats(docs.limit(0)).count() == 0


def brute_lines(rows, window=3, long_words=10):
    runs, listed = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        listed[doc_id] = (lines, full)
        for p in range(len(full) - window + 1):
            runs.setdefault(tuple(lines[i] for i in full[p : p + window]), []).append((doc_id, p))
        for p, i in enumerate(full):
            if len(lines[i].split()) >= long_words:
                runs.setdefault((lines[i],), []).append((doc_id, p))
    gone = defaultdict(set)
    for run, where in runs.items():
        for doc_id, p in sorted(where)[1:]:
            gone[doc_id].update(listed[doc_id][1][p : p + len(run)])
    return {d: "\n".join(x for i, x in enumerate(lines) if i not in gone[d]) for d, (lines, _) in listed.items()}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_lines_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "d", "", " \t", "e f"]) + ("" if rng.random() < 0.6 else str(rng.randrange(9))) for _ in range(rng.randrange(1, 25)))) for i in range(80)]
    docs = spark.createDataFrame([(i, t, 1, "k", len(t)) for i, t in rows], "doc_id long, text string, run int, key string, n_chars long").repartition(4)
    got = line_dedup.dedup_lines(docs, long_words=2)
    assert got.columns == docs.columns
    want = brute_lines(rows, long_words=2)
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_long_lines_of_short_documents(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, "own\n" + long), (3, "own\nother"), (4, long + "\n" + long + "\nlast")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute_lines(rows) == {1: long, 2: "own", 3: "own\nother", 4: "last"}
    # each fingerprint of a window is selected by fewer rows than there are windows
    runs = line_dedup.windows_of(spark.createDataFrame([(1, "\n".join(map(str, range(300))))], "doc_id long, text string"), 3)
    assert 0 < runs.where("selects").count() < runs.count() == 298


def test_lines_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, "a\nb\nc\nz"), (2, "a\nb\nc"), (2, "a\nb\nc"), (3, "")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.text) for r in line_dedup.dedup_lines(docs).collect()), key=str)
    assert got == sorted([(1, None), (-1, "a\nb\nc\nz"), (2, ""), (2, ""), (3, "")], key=str)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def _mixed(spark):
    rng = random.Random(0)
    rows = []
    for i in range(4000):
        source = "big" if rng.random() < 0.5 else f"s{rng.randrange(5)}"
        rows.append((i, "x" * rng.randrange(1, 400), source, rng.choice(["en", "en", "de"]), rng.choice(["t1", "t2"])))
    rows += [(9000, None, None, None, None), (9001, "abcd", None, "en", "t1"), (None, "abcd" * 9, "big", "en", "t2")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string").repartition(4)


@pytest.mark.parametrize("one", [100_000, 0])
def test_raked_margins(spark, monkeypatch, one):
    monkeypatch.setattr(mixing, "ONE_PARTITION", one)
    cells = mixing.raked(_mixed(spark), rounds=12).toPandas()
    cells["w"] = cells["tokens"] * cells["scale"]
    for d in mixing.DIMENSIONS:
        m = cells.groupby(f"_{d}")[["tokens", "w"]].sum()
        target = m.tokens ** mixing.POWERS[d]
        assert (abs(m.w / m.w.sum() - target / target.sum()) < 1e-4).all()


def test_sample_follows_probabilities(spark):
    docs = _mixed(spark)
    rows = mixing.with_probability(docs).collect()
    assert len(rows) == docs.count()
    assert max(r.probability for r in rows) == pytest.approx(1)
    drawn = mixing.mix(docs)
    assert drawn.columns == docs.columns
    ids = [r.doc_id for r in drawn.collect()]
    expected = sum(r.probability for r in rows)
    assert abs(len(ids) - expected) < 5 * expected**0.5 and set(Counter(ids).values()) == {1}
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in mixing.sample(docs).collect())
    assert 9000 not in ids
    assert mixing.mix(docs.limit(0)).count() == 0
    assert "Python" not in drawn._jdf.queryExecution().executedPlan().toString()
