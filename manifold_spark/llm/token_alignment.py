"""Alignment of two tokenizers over a corpus.

A is a byte-level BPE (a file of the tokenizers library, special strings taken as
plain text), B a SentencePiece model. Both encode a space and the text, and the
byte offsets at which tokens of both end cut the tokens into groups: a merge of the
cumulative ends with two pointers, the one behind going on, in ``mapInArrow``. All
A-B pairs of occurrences in a group are links. A task writes, for each document, its
groups' digest and its linked id pairs with the number of their links, from the ids
of each side and how often a group holds them; occurrences are never paired one by
one. Spark counts the documents of each id pair, takes the highest count of each A id
and each B id, and joins both back to the documents' pairs.

Where both tokenizers are known to end a token - before a space after anything else
than white space, and at a line break, see :mod:`.pieces` - texts fall apart into
pieces, which repeat: each is encoded and merged once a worker, with a bounded memory.
Other texts, and all where a vocabulary could join pieces, are encoded and merged
whole. Pair counts go to the tasks by a broadcast while there are at most
``BROADCAST_PAIRS`` (vocabularies bound the maxima); more are joined by a shuffle in
which hot pairs stay where they are.

Nulls: null and empty texts, and texts whose joined token bytes on either side
aren't those of a space and the text, have no tokens: zeros and an empty digest.
Every row counts as a document of its own, with a null or repeated doc_id as well.
Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_counted, materialize, small_batches
from .pieces import _VISIBLE, MEMORY_CHARS, PieceEncoder, split_pieces

#: Pairs of (A id, B id, three numbers) that may be broadcast.
BROADCAST_PAIRS = 2_000_000
SPACE = "▁"


def merge(a: list[int], b: list[int], a_size: list[int], b_size: list[int]) -> list[tuple[list[int], list[int]]]:
    """The groups of two token sequences over the same bytes."""
    out, i, j, end_a, end_b, from_a, from_b = [], 0, 0, 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if end_a <= end_b:
            end_a += a_size[a[i]]
            i += 1
        else:
            end_b += b_size[b[j]]
            j += 1
        if end_a == end_b:
            out.append((a[from_a:i], b[from_b:j]))
            from_a, from_b = i, j
    return out


class Known:
    """What is remembered of a piece, or found of a whole text: the digest's text, the numbers of tokens and the linked pairs."""

    __slots__ = ("digest", "links", "many", "n_a", "n_b")

    def __init__(self, a: list[int], b: list[int], a_size: list[int], b_size: list[int]):
        # one token on a side ends nowhere but at the end
        groups = [(a, b)] if len(a) == 1 or len(b) == 1 else merge(a, b, a_size, b_size)
        self.digest = ";".join([f"{x[0]}|{y[0]}" if len(x) == len(y) == 1 else ",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups])
        self.n_a, self.n_b = len(a), len(b)
        # a pair stands here once for each of its links, but for groups of many tokens, whose pairs come with a number
        self.links: list[int] = []
        self.many: list[tuple[int, int]] = []
        for x, y in groups:
            if len(x) * len(y) <= 64:
                self.links += [i << 32 | j for i in x for j in y]
            else:
                of_y = Counter(y).items()
                self.many += [(i << 32 | j, n * m) for i, n in Counter(x).items() for j, m in of_y]


class Aligner:
    def __init__(self, a_path: str, b_path: str, max_pieces: int = 250_000):
        import sentencepiece

        self.encoder = PieceEncoder(a_path)
        self.encoder.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: chr(b) for b, c in _VISIBLE.items()}
        tokenizer = self.encoder.tokenizer
        self.a_bytes = [(tokenizer.id_to_token(i) or "").translate(byte_of).encode("latin-1", "replace") for i in range(tokenizer.get_vocab_size())]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        # a piece that goes on after a space or holds a line break would join what is cut here
        self.splits = self.encoder.splits and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in names)
        self.max_pieces, self.known = max_pieces, {}

    def _known(self, data: bytes, a: list[int], b: list[int]) -> Known | None:
        """None where a side's bytes aren't ``data``."""
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        return Known(a, b, self.a_size, self.b_size)

    def _whole(self, text: str) -> Known | None:
        a = np.frombuffer(self.encoder._whole(" " + text), self.encoder.dtype).tolist()
        return self._known((" " + text).encode(), a, self.b.encode(text))

    def _learn(self, pieces: list[str]) -> dict[str, Known | None]:
        of_a, of_b, out = self.encoder.encode_pieces(pieces), self.b.encode(pieces, num_threads=1), {}
        for p, a, b in zip(pieces, of_a, of_b, strict=True):
            # B puts a space before each; before a line break that space is a token of its own and no part of the text
            a, broken = np.frombuffer(a, self.encoder.dtype).tolist(), p[:1] == "\n"
            if broken and (not b or self.b_bytes[b[0]] != b" "):
                raise ValueError(f"the model joins a space and {p!r}")
            out[p] = self._known((p if broken else " " + p).encode(), a, b[1:] if broken else b)
        return out

    def align(self, texts: list[str | None]) -> list[Aligned | None]:
        """None for texts without tokens."""
        split = [(split_pieces(t, ()) if self.splits and t[0] not in " \n" and t[-1] != " " and SPACE not in t else None) if t else [] for t in texts]
        # the line break that a split begins with is no part of the text, and its first word follows the space
        split = [[p[0][1:], *p[1:]] if p else p for p in split]
        known = self.known
        missing = list(set().union(*(p for p in split if p)) - known.keys())
        found = self._learn(missing)
        if len(known) < self.max_pieces:
            known.update([(p, k) for p, k in found.items() if len(p) <= MEMORY_CHARS][: self.max_pieces - len(known)])
        out = []
        for t, pieces in zip(texts, split, strict=True):
            if not t:
                out.append(None)
            elif pieces is None:
                whole = self._whole(t)
                out.append(Aligned([whole]) if whole else None)
            else:
                parts = [known.get(p) or found.get(p) for p in pieces]
                out.append(None if None in parts else Aligned(parts))
        return out


class Aligned:
    """A document: counts, digest and the number of links of each pair."""

    def __init__(self, parts: list[Known]):
        text = ";".join([k.digest for k in parts])
        self.digest = hashlib.sha256(text.encode()).hexdigest()
        self.links = Counter(chain.from_iterable([k.links for k in parts]))
        for k in parts:
            if k.many:
                for pair, n in k.many:
                    self.links[pair] += n
        self.counts = [sum([k.n_a for k in parts]), sum([k.n_b for k in parts]), text.count("|"), self.links.total()]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of this worker process."""
    if (a_path, b_path) not in _aligners:
        _aligners.clear()
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


_ROW = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<long>"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A written table with a row a document: row (its number), doc_id, the counts and digest, and its pairs a, b with ``times`` links each."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path).align
        for batch in batches:
            docs = align(batch.column("text").to_pylist())
            counts, digests = [d.counts if d else [0, 0, 0, 0] for d in docs], [d.digest if d else "" for d in docs]
            ends = np.cumsum([0, *(len(d.links) if d else 0 for d in docs)]).astype(np.int32)
            code, times = (np.fromiter((x for d in docs if d for x in of(d.links)), np.int64, ends[-1]) for of in (dict.keys, dict.values))
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((code >> 32).astype(np.int32), (code & 0xFFFFFFFF).astype(np.int32), times)]
            columns = [pa.array(c) for c in np.array(counts, np.int64).reshape(-1, 4).T]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *columns, pa.array(digests, pa.string()), *lists], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"])

    return materialize(rows.mapInArrow(work, _ROW), "aligned")


def pairs_of(table: DataFrame) -> DataFrame:
    """row, a, b, times: the linked id pairs of each document."""
    return table.select("row", F.inline(F.arrays_zip("a", "b", "times")))


def pair_counts(table: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked), best_a and best_b (whether n is the highest of the A id, of the B id)."""
    counts = materialize(pairs_of(table).groupBy("a", "b").agg(F.count("*").alias("n")), "pair-counts")
    # a row for each id of a vocabulary at most
    top_a, top_b = counts.groupBy("a").agg(F.max("n").alias("top_a")), counts.groupBy("b").agg(F.max("n").alias("top_b"))
    best = counts.join(F.broadcast(top_a), "a").join(F.broadcast(top_b), "b")
    return materialize(best.select("a", "b", "n", (F.col("n") == F.col("top_a")).alias("best_a"), (F.col("n") == F.col("top_b")).alias("best_b")), "best-pairs")


def report(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and n_best_b (links that are the best of their B id)."""
    table = aligned(docs, a_path, b_path)
    counts, pairs = pair_counts(table), pairs_of(table)
    both = pairs.join(F.broadcast(counts), ["a", "b"]) if counts.count() <= broadcast_pairs else join_counted(pairs, counts, ["a", "b"])
    links = lambda c: F.sum(F.when(F.col(c), F.col("times")).otherwise(0))
    sums = both.groupBy("row").agg(links("best_a").alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"), links("best_b").alias("n_best_b"))
    of = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    head = table.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return head.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", of("n_best"), of("count_sum"), "groups_sha256", of("n_best_b"))
