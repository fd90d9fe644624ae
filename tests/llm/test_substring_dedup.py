"""Substring dedup against a dictionary of all windows."""

import random

import numpy as np
import pytest

from manifold_spark.llm import substring_dedup
from manifold_spark.llm.substring_dedup import NEVER, SuffixAutomaton

SCHEMA = "doc_id long, text string, words string, n long, start long"


def expected(rows, k):
    first = {}
    split = [(d, t.encode().split() if t else []) for d, t in rows]
    for d, ws in split:
        for p in range(len(ws) - k + 1):
            if d is not None:
                key = tuple(ws[p : p + k])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, ws in split:
        gone = set()
        for p in range(len(ws) - k + 1):
            if d is not None and first[tuple(ws[p : p + k])] < d:
                gone |= set(range(p, p + k))
        out.append((d, len(ws), len(gone), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return out


def corpus(k, n=60):
    rng = random.Random(k)
    word = lambda: rng.choice("ab cd é fg hi jk lm no pq rs tu vw xyz".split())
    passages = [[word() for _ in range(rng.randint(k - 1, 3 * k))] for _ in range(6)]
    rows = []
    for i in range(n):
        ws = []
        for _ in range(rng.randint(0, 4)):
            ws += [word() for _ in range(rng.randint(0, k))]
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "changed"
            ws += p
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(ws)))
    rows += [(i, t) for i, t in rows[:5]] + [(100 + i, t) for i, t in rows[:12]]
    return rows + [(None, rows[7][1]), (None, None), (3, rows[9][1]), (200, None), (201, ""), (202, " \n "), (203, " ".join(["x"] * (4 * k))), (204, " ".join(["x"] * (3 * k)))]


def key(r):
    return tuple("" if x is None else str(x) for x in r)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(d, t, "a", 1, 2) for d, t in rows], SCHEMA).repartition(4)
    got = substring_dedup.dedup(df, **settings).collect()
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=key)


@pytest.mark.parametrize(("shard", "most"), [(substring_dedup.SHARD_WORDS, substring_dedup.BROADCAST_WORDS), (2000, 0), (60, 0)])
def test_equals_brute_force(spark, shard, most):
    rows = corpus(20)
    assert run(spark, rows, min_words=20, w=6, shard_words=shard, broadcast_words=most) == sorted(expected(rows, 20), key=key)


def test_one_passage_in_many_surroundings(spark):
    """An anchor with more words than a shard: counted by windows."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([f"l{rng.random()}" for _ in range(20)] + common + [f"r{rng.random()}" for _ in range(20)])) for i in range(40)]
    got = run(spark, rows, shard_words=500, broadcast_words=0)
    assert got == sorted(expected(rows, 50), key=key) and sum(r[2] for r in got) == 39 * 60


def test_large_groups_of_copies(spark):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    rows = [(i, text) for i in range(3000)] + [(5000 + i, text + f" end{i}") for i in range(500)]
    assert run(spark, rows) == sorted(expected(rows, 50), key=key)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (None, "a b")]) == [(None, 2, 0, "a b"), (1, 0, 0, "")]


def test_automaton_matches():
    rng = np.random.default_rng(3)
    for _ in range(20):
        texts = [rng.integers(0, 3, rng.integers(1, 40)).tolist() for _ in range(5)]
        a = SuffixAutomaton()
        for d, t in enumerate(texts):
            a.add(t, d)
        a.finish()
        query = rng.integers(0, 4, 60).tolist()
        for least in (1, 3, 6):
            want = [min([d for d, t in enumerate(texts) if any(t[p : p + least] == query[i : i + least] for p in range(len(t)))], default=NEVER) for i in range(60 - least + 1)]
            assert a.matches(query, least).tolist() == want
