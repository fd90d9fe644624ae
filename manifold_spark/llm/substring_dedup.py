"""Repeated passages removed by suffix automata.

A window is ``min_words`` consecutive words of a document. Each word goes that a
window covers whose words also stand in a document with a smaller doc_id; windows
are judged on the input.

What can repeat at all is told first: every window is stood for by a minimiser (the
position whose 8-word hash is least among its first ``w``), and the 35 words from
there on by a hash; a window is a candidate if documents of two ids hold that hash
(:func:`shared_suffixes`, a bitmap of fixed size whose false hits only cost work).
Candidates are cut into passages, consecutive windows with the same least 8-word
hash of all that they hold, so equal windows are in passages with the same anchor.
Distinct passages are the reference. They are dealt over shards of about
``SHARD_WORDS`` words by their anchors; of each shard a generalised suffix automaton
is built, whose states know the smallest doc_id that holds them (found by following
suffix links). Passages are streamed through the automaton of their shard: matching
statistics of ``min_words`` or more give the smallest doc_id of each window. Windows
that stand in smaller ids are joined back to their places, and all that cover words
of a document make its maximal spans.

A reference of ``broadcast_words`` words at most is broadcast, as automata that a task
loads by shard. The repeated part of a corpus has no such bound: beyond it each
automaton meets the passages of its shard by the shuffle that built it. An anchor
with more words than a shard (a phrase in ever new surroundings) would be a shard
that grows with the corpus: its windows are counted one by one, by two 64-bit hashes.
Results don't depend on these switches. Passages are sent once a task and distinct
ones are aggregated before the shuffle; those that many documents hold are joined by
a broadcast of at most 2048 keys, so a hot passage or a group of copies loads no task.

Words are compared by 64-bit hashes of their bytes, passages by 128 bits.

Nulls: a null text has no words. A row with a null doc_id keeps all words and is no
reference. Rows that repeat, and rows of one doc_id with other texts, don't count as
smaller than each other. Empty texts and those under ``min_words`` words are kept
whole. Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_counted, materialize, small_batches
from .copies import bitmap, hits
from .suffix_dedup import GRAM, suffixes
from .words import distinct, long_windows, mix, windows

SHARD_WORDS = 150_000
BROADCAST_WORDS = 500_000
NEVER = np.iinfo(np.int64).max


class SuffixAutomaton:
    """Of several sequences; ``first`` has the smallest document of each state after :meth:`finish`."""

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [NEVER]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.first.append(NEVER)
        return len(self.length) - 1

    def _copy(self, p: int, symbol: int, q: int) -> int:
        """A state for the shorter strings of ``q`` that end a longest string of ``p`` and the symbol."""
        c = self._state(self.length[p] + 1, self.next[q].copy(), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        return c

    def add(self, symbols: list[int], document: int) -> None:
        moves, link, length, first, last = self.next, self.link, self.length, self.first, 0
        for s in symbols:
            q = moves[last].get(s)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._copy(last, s, q)
            else:
                new, p = self._state(length[last] + 1, {}, 0), last
                while p >= 0 and s not in moves[p]:
                    moves[p][s] = new
                    p = link[p]
                if p >= 0:
                    q = moves[p][s]
                    link[new] = q if length[q] == length[p] + 1 else self._copy(p, s, q)
                last = new
            if document < first[last]:
                first[last] = document

    def finish(self) -> SuffixAutomaton:
        """Hand the smallest documents up the suffix links, longest states first."""
        first, link = self.first, self.link
        for v in np.argsort(-np.array(self.length), kind="stable")[:-1].tolist():
            if first[v] < first[link[v]]:
                first[link[v]] = first[v]
        return self

    def matches(self, symbols: list[int], least: int) -> np.ndarray:
        """The smallest document that holds each window of ``least`` symbols; NEVER where none does."""
        moves, link, length, first = self.next, self.link, self.length, self.first
        out, v, n = np.full(max(len(symbols) - least + 1, 0), NEVER), 0, 0
        for i, s in enumerate(symbols):
            while v and s not in moves[v]:
                v = link[v]
                n = length[v]
            if s in moves[v]:
                v, n = moves[v][s], n + 1
            if n >= least:
                u = v
                while length[link[u]] >= least:
                    u = link[u]
                out[i - least + 1] = first[u]
        return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))


def shared_suffixes(texts: DataFrame, min_words: int, w: int) -> np.ndarray:
    """A bitmap of the minimiser suffixes that documents of two ids or more hold."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, keys = [], [np.empty(0, np.uint64)]
            for text in b.column("text").to_pylist():
                _, m, key = suffixes(text, min_words, w)
                keys.append(distinct(key[distinct(m)]) if len(m) else key[:0])
                doc.append(len(keys[-1]))
            at = pa.array(np.repeat(np.arange(b.num_rows), doc))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), pa.array(np.concatenate(keys).view(np.int64))], names=["doc_id", "key"])

    found = texts.select("doc_id", "text").mapInArrow(own, "doc_id long, key long").groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return bitmap(found.where("a < b").select("key"))


def _passages(text: str, shared: np.ndarray, min_words: int, w: int):
    """Words of a text, and start, end and anchor of each of its passages."""
    words, m, key = suffixes(text, min_words, w)
    at = np.flatnonzero(hits(shared, key[m])) if len(m) else m
    if not len(at):
        return words, at, at, at
    gram = windows(words, GRAM)
    width = min_words - GRAM + 1
    anchor = np.arange(len(m)) + sliding_window_view(gram[: len(m) + width - 1], width).argmin(axis=1)
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (anchor[at[1:]] != anchor[at[:-1]]))))
    return words, at[cut], at[np.append(cut[1:], len(at)) - 1] + min_words, gram[anchor[at[cut]]].view(np.int64)


def places_of(texts: DataFrame, shared: np.ndarray, min_words: int, w: int, remember: int = 200_000) -> DataFrame:
    """A written table of passages in their places: doc_id, text_key, start, anchor, k1, k2 (the passage's name), and its word hashes once a task."""
    bits = texts.sparkSession.sparkContext.broadcast(shared)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            row, start, anchor, names, words = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                every, a, z, k = _passages(text, bits.value, min_words, w)
                row.append(len(a))
                if len(a):
                    start.append(a)
                    anchor.append(k)
                    raw = every.tobytes()
                    for x, y in zip((8 * a).tolist(), (8 * z).tolist(), strict=True):
                        name = xxhash.xxh3_128_digest(raw[x:y])
                        names.append(name)
                        words.append(None if name in seen else raw[x:y])
                        seen.add(name)
                    if len(seen) > remember:  # later ones are sent again
                        seen.clear()
            if names:
                at, k = pa.array(np.repeat(np.arange(b.num_rows), row)), np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), b.column("text_key").take(at), pa.array(np.concatenate(start), pa.int32()), pa.array(np.concatenate(anchor)), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(words, pa.binary())],
                    names=["doc_id", "text_key", "start", "anchor", "k1", "k2", "words"],
                )

    return materialize(texts.mapInArrow(found, "doc_id long, text_key long, start int, anchor long, k1 long, k2 long, words binary"), "places")


def _symbols(words: pd.Series) -> list[list[int]]:
    """Passages with their words numbered: small numbers are quicker."""
    parts = [np.frombuffer(x, np.uint64) for x in words]
    _, number = np.unique(np.concatenate(parts), return_inverse=True)
    return [x.tolist() for x in np.split(number, np.cumsum([len(p) for p in parts])[:-1])]


def _automaton(symbols: list[list[int]], first) -> SuffixAutomaton:
    out = SuffixAutomaton()
    for s, d in zip(symbols, first, strict=True):
        out.add(s, int(d))
    return out.finish()


_RESULT = "k1 long, k2 long, firsts array<long>"


def _by_shards(passages: DataFrame, shards: int, min_words: int, broadcast: bool) -> DataFrame:
    """k1, k2 and the smallest doc_id that holds each window of a passage."""
    dealt = passages.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")).select("shard", "k1", "k2", "first", "words")
    if not broadcast:

        def stream(rows: pd.DataFrame) -> pd.DataFrame:
            symbols = _symbols(rows["words"])
            automaton = _automaton(symbols, rows["first"])
            return pd.DataFrame({"k1": rows["k1"], "k2": rows["k2"], "firsts": [automaton.matches(s, min_words) for s in symbols]})

        return dealt.groupBy("shard").applyInPandas(stream, _RESULT)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        automaton = _automaton([np.frombuffer(x, np.uint64).tolist() for x in rows["words"]], rows["first"])
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "automaton": [pickle.dumps(automaton)]})

    # at most broadcast_words words
    built = {r["shard"]: bytes(r["automaton"]) for r in dealt.groupBy("shard").applyInPandas(build, "shard int, automaton binary").collect()}
    held = passages.sparkSession.sparkContext.broadcast(built)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[int, SuffixAutomaton] = {}
        for b in batches:
            firsts = []
            for shard, words in zip(b.column("shard").to_pylist(), b.column("words").to_pylist(), strict=True):
                if shard not in loaded:
                    loaded[shard] = pickle.loads(held.value[shard])  # noqa: S301  this job's own objects
                firsts.append(loaded[shard].matches(np.frombuffer(words, np.uint64).tolist(), min_words))
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(firsts, pa.list_(pa.int64()))], names=["k1", "k2", "firsts"])

    return dealt.mapInArrow(look_up, _RESULT)


def _by_windows(passages: DataFrame, min_words: int) -> DataFrame:
    """The same by a row for each window, whatever number of passages share an anchor."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(x, np.uint64) for x in b.column("words").to_pylist()]
            n = [len(p) - min_words + 1 for p in parts]
            at = pa.array(np.repeat(np.arange(b.num_rows), n))
            one, two = (np.concatenate([np.empty(0, np.uint64), *(long_windows(f(p), min_words) for p in parts)]).view(np.int64) for f in (lambda p: p, mix))
            place = np.concatenate([np.empty(0, np.int64), *(np.arange(x) for x in n)])
            yield pa.RecordBatch.from_arrays([b.column("k1").take(at), b.column("k2").take(at), b.column("first").take(at), pa.array(place, pa.int32()), pa.array(one), pa.array(two)], names=["k1", "k2", "first", "p", "w1", "w2"])

    rows = materialize(passages.select("k1", "k2", "first", "words").mapInArrow(each, "k1 long, k2 long, first long, p int, w1 long, w2 long"), "windows")
    least = materialize(rows.groupBy("w1", "w2").agg(F.min("first").alias("least"), F.count("*").alias("n")), "least")
    back = join_counted(rows.drop("first"), least, ["w1", "w2"])
    return back.groupBy("k1", "k2").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "least"))), lambda x: x["least"]).alias("firsts"))


def removed_windows(docs: DataFrame, min_words: int = 50, w: int = 16, shard_words: int = SHARD_WORDS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """A written table: doc_id, text_key and starts, the first words (from 0) of the windows that stand in a smaller doc_id."""
    small_batches(docs.sparkSession)
    texts = _texts(docs).where("doc_id is not null and text is not null")
    places = places_of(texts, shared_suffixes(texts, min_words, w), min_words, w)
    passages = places.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.max("anchor").alias("anchor"), F.max("words").alias("words"))
    passages = materialize(passages, "passages")
    size = F.octet_length("words") / 8
    by_anchor = passages.groupBy("anchor").agg(F.sum(size).alias("size"))
    total = int(by_anchor.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    wide = materialize(by_anchor.where(F.col("size") > shard_words).select("anchor"), "wide-anchors")
    found = _by_shards(passages.join(wide, "anchor", "left_anti"), -(-total // shard_words) or 1, min_words, total <= broadcast_words)
    if wide.take(1):
        found = found.union(_by_windows(passages.join(wide, "anchor", "left_semi"), min_words))
    found = materialize(found, "matches").join(passages.select("k1", "k2", "n"), ["k1", "k2"])
    # of most passages no window stands anywhere else; the rest meets its places
    found = found.where(F.exists("firsts", lambda d: d < F.lit(NEVER)))
    met = join_counted(places.drop("words", "anchor"), materialize(found, "found"), ["k1", "k2"])
    starts = F.transform(F.filter(F.sequence(F.lit(0), F.size("firsts") - 1), lambda o: F.get("firsts", o) < F.col("doc_id")), lambda o: o + F.col("start"))
    met = met.select("doc_id", "text_key", starts.alias("s")).where(F.size("s") > 0)
    return materialize(met.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("s")).alias("starts")), "removed")


_SCHEMA = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>"


def dedup(docs: DataFrame, min_words: int = 50, w: int = 16, shard_words: int = SHARD_WORDS, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and spans, the removed runs of words (end exclusive)."""
    removed = removed_windows(docs, min_words, w, shard_words, broadcast_words)
    touched = docs.sparkSession.sparkContext.broadcast(bitmap(removed.select(F.xxhash64("doc_id", "text_key").alias("key"))))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def cut(doc_id: pa.Array, texts: list, starts: list) -> pa.RecordBatch:
        n, gone, kept, spans = [], [], [], []
        for text, at in zip(texts, starts, strict=True):
            words = text.encode().split() if text else []  # at the six blanks of ASCII, as words are defined
            runs = []
            if at:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, np.array(at) + min_words, -1)
                covered = np.cumsum(edge) > 0
                change = np.diff(covered.astype(np.int8), prepend=0)
                runs = list(zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True))
                kept_words = [x for x, c in zip(words, covered[:-1].tolist(), strict=True) if not c]
            else:
                kept_words = words
            n.append(len(words))
            gone.append(len(words) - len(kept_words))
            kept.append(b" ".join(kept_words).decode())
            spans.append([{"start": a, "end": z} for a, z in runs])
        return pa.RecordBatch.from_arrays([doc_id, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(span))], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(~hits(touched.value, b.column("key").to_numpy())))
            if b.num_rows:
                yield cut(b.column("doc_id"), b.column("text").to_pylist(), [None] * b.num_rows)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(hits(touched.value, b.column("key").to_numpy())))

    def touched_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield cut(b.column("doc_id"), b.column("text").to_pylist(), b.column("starts").to_pylist())

    keyed = _texts(docs).withColumn("key", F.xxhash64("doc_id", "text_key"))
    # a small side by document; copies of one row may be many, and are split where they are
    both = keyed.mapInArrow(maybe, keyed.schema).join(removed.hint("shuffle_hash"), ["doc_id", "text_key"], "left")
    return keyed.mapInArrow(untouched, _SCHEMA).union(both.select("doc_id", "text", "starts").mapInArrow(touched_rows, _SCHEMA))


def report(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words."""
    return dedup(docs, min_words).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT r, doc_id, unnest(range(1, len(words) - 48)) AS p, unnest([md5(array_to_string(words[q:q + 49], ' ')) FOR q IN range(1, len(words) - 48)]) AS h FROM w WHERE len(words) >= 50),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
x AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS q FROM g JOIN f USING (h) WHERE first < doc_id),
e AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS q FROM w),
k AS (SELECT r, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n FROM e ANTI JOIN x USING (r, q) GROUP BY r)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (r)
"""
