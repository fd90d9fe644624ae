import itertools
import random

import pytest

from manifold_spark.llm import jaccard_join as J


def brute(rows, k=5, percent=80):
    sets = {}
    for i, (doc_id, text) in enumerate(rows):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    groups = {}
    for i in sets:
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[find(i)])) for i in sets)


def corpus(seed, vocabulary=400, n=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passage = [word() for _ in range(60)]
    rows = [None, "", " \n\t", "one", "ONE", "one two", "one two three four five", "é one", "One Two three\x0bfour five"]
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 8, 30, 80, 300]))]
        if rng.random() < 0.5:
            base[2:2] = passage
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,joined,tile", [(1, 64, 1024), (2, 2, 3)])
def test_components_equal_brute_force(spark, monkeypatch, seed, joined, tile):
    monkeypatch.setattr(J, "JOINED", joined)
    monkeypatch.setattr(J, "TILE", tile)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, class string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.components(docs).collect())
    assert got == brute(rows)


def test_small_vocabulary_and_no_order(spark, monkeypatch):
    monkeypatch.setattr(J, "JOINED", 3)
    monkeypatch.setattr(J, "TILE", 4)
    rows = corpus(3, vocabulary=3, n=30)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, J.components(docs).collect())) == brute(rows)
    kept = {r.doc_id for r in J.one_of_each(docs).collect()}
    assert kept == {d for d, _, c in brute(rows) if d == c}


def test_empty_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (7, "A b c d e f"), (8, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id) for r in J.components(docs).collect())
    assert got == [(-1, 4), (4, 4), (4, 4), (7, 4), (8, 8)]
    assert J.components(docs.limit(0)).count() == 0
