import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from manifold_spark.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


class KneserNey:
    """An independent model: dictionaries of strings, recursion by order."""

    def __init__(self, texts, order):
        self.order = order
        grams = [Counter() for _ in range(order + 1)]
        for t in texts:
            t = " " * (order - 1) + t
            grams[order].update(t[i : i + order] for i in range(len(t) - order + 1))
        for k in range(order - 1, 0, -1):
            grams[k] = Counter(g[1:] for g in grams[k + 1])
        self.grams, self.symbols = grams, len(grams[1])
        self.total, self.away, self.d = [None], [None], [None]
        for k in range(1, order + 1):
            n = [sum(c == i for c in grams[k].values()) for i in range(1, 5)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
            d = [0.0]
            for i in (1, 2, 3):
                d.append(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.01) if n[i - 1] and n[i] else (0.5, 1.0, 1.5)[i - 1])
            total, away = defaultdict(float), defaultdict(float)
            for g, c in grams[k].items():
                total[g[:-1]] += c
                away[g[:-1]] += d[min(c, 3)]
            self.total.append(total)
            self.away.append(away)
            self.d.append(d)

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (self.symbols + 1)
        if gram[:-1] not in self.total[k]:
            return self.p(gram[1:])
        c = self.grams[k].get(gram, 0)
        return (c - self.d[k][min(c, 3)]) / self.total[k][gram[:-1]] + self.away[k][gram[:-1]] / self.total[k][gram[:-1]] * self.p(gram[1:]) if c else self.away[k][gram[:-1]] / self.total[k][gram[:-1]] * self.p(gram[1:])

    def log_perplexity(self, text):
        t = " " * (self.order - 1) + text
        return -sum(math.log(self.p(t[i : i + self.order])) for i in range(len(text))) / len(text)


def brute_kept(rows, order, spread=4.0, slack=1.5):
    """doc_id -> (kept, log-perplexity), from the definition."""
    by_lang = defaultdict(list)
    for i, (_, text, lang) in enumerate(rows):
        if text:
            by_lang[lang].append(i)
    value, ok = {}, defaultdict(dict)
    for lang, at in by_lang.items():
        model = KneserNey({rows[i][1] for i in at}, order)
        for i in at:
            value[i] = model.log_perplexity(rows[i][1])
            n, _, _, _, repeated = brute(rows[i][1])
            if not Q.base_failed(n, repeated):
                ok[lang][rows[i][1]] = round(value[i], 4)
    q = {lang: (len(x), *np.quantile(list(x.values()), [0.25, 0.5, 0.75])) for lang, x in ok.items()}
    n_all = sum(x[0] for x in q.values())
    mean_low, mean_high = (sum(x[0] * d for x, d in zip(q.values(), ds, strict=True)) / n_all for ds in ([x[2] - x[1] for x in q.values()], [x[3] - x[2] for x in q.values()]))
    out = {}
    for i, (_, text, lang) in enumerate(rows):
        n, _, _, _, repeated = brute(text)
        kept = not Q.base_failed(n, repeated)
        if kept:
            m, lo, mid, hi = q[lang]
            room = slack / math.sqrt(len(text))
            low, high = (spread * max((m * d + 20 * a) / (m + 20), 0.01) * (1 + 20 / m) for d, a in ((mid - lo, mean_low), (hi - mid, mean_high)))
            kept = mid - low - room <= value[i] <= mid + high + room
        out[i] = kept, value.get(i)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_base_counts(seed):
    rng = random.Random(seed)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bé", " ", " ", "\n", "\t", "\x0b", "|", "#x", "a b a b a ", "\x85", " "]) for _ in range(rng.randrange(60)))
        assert Q.base_counts(text) == brute(text)
    assert Q.base_counts(None) == (0, 0, 0, 0, 0)


SYLLABLES = {"en": "an the er on re in ed sh", "ru": "на ст ко ре ни ва ло ми", "zh": "的 一 是 不 了 人 我 在 有 他 这 中 大 来 上"}
JUNK = {"en": "qzxv#*", "ru": "щъэюфц", "zh": "龘靐齉爩麤灪"}


def _rows(seed=3, n=70):
    rng = random.Random(seed)
    rows = []
    for lang, syllables in SYLLABLES.items():
        pool = syllables.split()
        for _ in range(n):
            rows.append((len(rows), " ".join("".join(rng.choice(pool) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(60, 140))), lang))
    junk = []
    for lang, letters in JUNK.items():
        rows.append((len(rows), " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(80)), lang))
        junk.append(rows[-1][0])
    rows += [(1000 + i, rows[5][1], "en") for i in range(150)]  # copies
    rows += [(2000, None, "en"), (2001, "", None), (2002, "one two", "xx"), (2003, "a b c d e f g h i j k l", None), (None, "same words " * 30, "en"), (2004, " ".join(f"w{i}" for i in range(30)), "rare")]
    return rows, junk


@pytest.fixture(scope="module")
def made(spark):
    rows, junk = _rows()
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, lang string, n_words int, row string, kept string").repartition(3)
    return rows, junk, docs


@pytest.mark.parametrize("entries,piece", [(Q.MODEL_ENTRIES, Q.PIECE), (0, 97)])
def test_verdicts_equal_brute_force(spark, monkeypatch, made, entries, piece):
    """Both ways of looking up the model, and texts cut into parts, against a model of dictionaries."""
    rows, junk, docs = made
    monkeypatch.setattr(Q, "MODEL_ENTRIES", entries)
    monkeypatch.setattr(Q, "PIECE", piece)
    monkeypatch.setattr(Q, "GROUP_CHARS", 20_000)
    want = {rows[i][0]: x for i, x in brute_kept(rows, Q.ORDER).items()}
    got = Q.judge(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        assert r.base_failed == Q.base_failed(r.n_words, r.n_repeat_words)
        kept, value = want[r.doc_id]
        assert r.kept == kept, r
        assert (r.log_perplexity is None) == (value is None)
        if value is not None:
            assert r.log_perplexity == pytest.approx(value, rel=1e-4)
    by_id = {r.doc_id: r for r in got}
    # junk in every script goes, and of the clean texts hardly any
    assert not any(by_id[i].kept for i in junk) and not any(by_id[i].base_failed for i in junk)
    clean = [r for r in got if r.doc_id is not None and r.doc_id < junk[0] and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean) > 0
    assert by_id[2003].kept and by_id[2004].kept and not by_id[None].kept


def test_keep_good_keeps_rows_and_columns(spark, made):
    rows, _, docs = made
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in Q.judge(docs).where("kept").collect())
    odd = docs.selectExpr("doc_id", "text", "lang", "1 as _lang", "2 as _text", "3 as text_key", "4 as n_chars", "5 as log_perplexity", "6 as N_WORDS")
    assert Q.keep_good(odd).columns == odd.columns and Q.keep_good(odd).count() == kept.count()
    assert Q.judge(docs.limit(0)).count() == 0 and Q.keep_good(docs.limit(0)).count() == 0


def test_a_model_in_parts_judges_alike_and_hands_on_no_grams(spark, monkeypatch, made):
    rows, _, docs = made
    whole = {r.doc_id: r for r in Q.judge(docs).collect()}
    good = sorted(str(tuple(r)) for r in Q.keep_good(docs).collect())
    asked, written = [], []
    by_parts, write = Q._by_parts, Q.materialize
    monkeypatch.setattr(Q, "MODEL_ENTRIES", 1 + Q.Model(docs, Q.F.struct("doc_id").alias("row"), Q.ORDER).table.count() // 3)
    monkeypatch.setattr(Q, "PIECE", 97)
    monkeypatch.setattr(Q, "_by_parts", lambda *a: asked.append(a[-1]) or by_parts(*a))
    monkeypatch.setattr(Q, "materialize", lambda df, name: written.append((name, df.columns)) or write(df, name))
    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    assert asked == [3] and got.keys() == whole.keys()
    for i, r in got.items():
        want = whole[i].asDict()
        assert {k: v for k, v in r.asDict().items() if k != "log_perplexity"} == {k: v for k, v in want.items() if k != "log_perplexity"}
        assert r.log_perplexity == (want["log_perplexity"] if want["log_perplexity"] is None else pytest.approx(want["log_perplexity"], rel=1e-9))
    # documents are not written
    del written[:]
    assert sorted(str(tuple(r)) for r in Q.keep_good(docs).collect()) == good
    assert asked == [3, 3] and not any({"row", "text"} & set(columns) for _, columns in written)


def test_few_texts_have_wide_bands(spark):
    rows, _ = _rows(n=3)
    docs = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] < 9], "doc_id long, text string, lang string")
    assert Q.judge(docs).where("not kept").count() == 0


def test_unseen_symbols_back_off():
    order = 3
    model = KneserNey(["abcab cabc", "bca bc"], order)
    entries = {}
    for k in range(1, order + 1):
        for g in model.grams[k]:
            entries[k, g] = math.log(model.p(g))
        for c in model.total[k]:
            entries[Q._CONTEXT + k, c] = math.log(model.away[k][c] / model.total[k][c])
    entries[Q._UNIFORM, ""] = math.log(1 / (model.symbols + 1))

    def key(tag, g):
        s = np.array([ord(c) for c in g], np.uint64)
        return Q._tagged(Q._poly(s, np.array([len(s) - 1]), len(s)), tag)[0]

    table = Q.SortedHashes(np.array([key(t, g) for t, g in entries]), np.array(list(entries.values()), np.float32))
    for text in ("abc", "zab", "cz bcaé", "a"):
        assert Q.log_perplexities(table, [text], order)[0] == pytest.approx(model.log_perplexity(text), rel=1e-5)
    # all symbols that follow a context, and one for all others, have chances that sum to one
    for context in ("ab", "  ", "zz", "bc"):
        assert sum(model.p(context + c) for c in model.grams[1]) + model.p(context + "é") == pytest.approx(1)
