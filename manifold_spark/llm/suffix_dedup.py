"""Repeated passages by sparse suffix arrays.

Of a text's suffixes only those are kept that start at a minimiser: the position
whose 8-word hash is least in some window of ``w`` positions. A passage of
``min_words`` words that occurs twice has the same minimisers in both places, and
``min_words - w + 1`` words at least follow the first of them inside it. Suffixes
are told by the hash of so many words: a task sorts its own and passes each on
once with its number, all are range-partitioned and sorted, and one that is equal
to its neighbour, or comes with a number above one, is repeated. Of a repeated
suffix the match is extended to the left and to the right: by 0 to ``w - 1`` words
on the left and the rest on the right, to each passage of ``min_words`` words that
has the suffix as its minimiser. Extended matches are compared by two 64-bit
hashes of their words, and those that stand in two places or more are repeats.
Repeats of a document that touch make one span.

Equal texts are told first: of each such group only the first document takes part
in the search, and the others repeat it whole.

Counts are summed in each task before a shuffle, and passages with a large share
of all places are joined by a broadcast, so one that a third of all documents hold
loads no task; no pairs are made. The filter of repeated suffixes is a bitmap of
fixed size; false hits only cost work.

Nulls: a null text and one with fewer words than ``min_words`` has no repeats. A
null doc_id takes part. Rows with the same doc_id and text count as two places
but give their spans once; rows with the same doc_id and other texts have spans
of their own. Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_counted, materialize, small_batches
from .copies import DistinctTexts, bitmap, hits
from .words import long_windows, mix, windows, word_hashes

GRAM = 8
_BLANK = r"[ \t\n\x0b\x0c\r]+"


def minimisers(words: np.ndarray, min_words: int, w: int) -> np.ndarray:
    """For each start of a ``min_words`` window the position of the suffix that stands for it."""
    n = len(words) - min_words + 1
    if n <= 0:
        return np.empty(0, np.int64)
    return np.arange(n) + sliding_window_view(windows(words, GRAM)[: n + w - 1], w).argmin(axis=1)


def suffixes(text: str | None, min_words: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the suffix of each window, and the sort key of the suffix at each position."""
    words = word_hashes(text.encode("utf-8", "replace")) if text else np.empty(0, np.uint64)
    return words, minimisers(words, min_words, w), long_windows(words, min_words - w + 1)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("text_key", F.xxhash64("text"))


def repeated_suffixes(texts: DistinctTexts, min_words: int, w: int) -> np.ndarray:
    """A bitmap of the sort keys that two suffixes or more share."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.empty(0, np.uint64)]
            for text in b.column("text").to_pylist():
                _, m, key = suffixes(text, min_words, w)
                keys.append(key[m[np.concatenate((np.ones(1, bool), m[1:] != m[:-1]))]] if len(m) else key[:0])
            every = np.sort(np.concatenate(keys))
            first = np.flatnonzero(np.concatenate((np.ones(1, bool), every[1:] != every[:-1]))) if len(every) else np.empty(0, np.int64)
            n = np.diff(np.append(first, len(every)))
            yield pa.RecordBatch.from_arrays([pa.array(every[first].view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["key", "n"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            equal = np.concatenate(([last is not None and key[0] == last], key[1:] == key[:-1]))
            last = key[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(key[equal | (b.column("n").to_numpy() > 1)]))], names=["key"])

    ordered = materialize(texts.each(own, "key long, n byte"), "suffixes").repartitionByRange("key").sortWithinPartitions("key")
    return bitmap(ordered.mapInArrow(neighbours, "key long"))


def repeated_windows(texts: DistinctTexts, min_words: int, w: int) -> DataFrame:
    """doc_id, text_key, start and later (an equal window stands before it) of every repeated window; first_doc_id."""
    shared = texts.all.sparkSession.sparkContext.broadcast(repeated_suffixes(texts, min_words, w))

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, start, one, two = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words, m, key = suffixes(text, min_words, w)
                hit = np.flatnonzero(hits(shared.value, key[m]))
                if len(hit):
                    doc.append(np.full(len(hit), i))
                    start.append(hit)
                    one.append(long_windows(words, min_words)[hit])
                    two.append(long_windows(mix(words), min_words)[hit])
            if doc:
                at = pa.array(np.concatenate(doc))
                names = [pa.array(np.concatenate(x).view(np.int64)) for x in (one, two)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("text_key").take(at), pa.array(np.concatenate(start), pa.int32()), *names], names=["doc_id", "text_key", "start", "window", "window2"])

    places = materialize(texts.each(extended, "doc_id long, text_key long, start int, window long, window2 long"), "windows")
    on = ["window", "window2"]
    first = places.groupBy(*on).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "start")).alias("first")).where("n > 1")
    later = F.struct("doc_id", "text_key", "start") != F.col("first")
    return join_counted(places, materialize(first, "first-windows"), on).select("doc_id", "text_key", "start", later.alias("later"), F.col("first.doc_id").alias("first_doc_id"))


def repeats(docs: DataFrame, min_words: int = 50, w: int = 16) -> DataFrame:
    """One row a span: doc_id, start_word, end_word (exclusive), n_words, n_later_words, first_doc_id.

    ``n_later_words`` are the words of the span in windows that stand before it
    somewhere: what a deduplication removes. ``first_doc_id`` is the smallest
    doc_id that holds a part of the span.
    """
    small_batches(docs.sparkSession)
    texts = DistinctTexts(_texts(docs), ["doc_id"])
    by_doc = Window.partitionBy("doc_id", "text_key").orderBy("start")
    found = repeated_windows(texts, min_words, w)
    # words that this window adds to those of the later windows before it
    last = F.max(F.when(F.col("later"), F.col("start"))).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    adds = F.when(F.col("later"), F.least(F.lit(min_words), F.col("start") - F.coalesce(last, F.col("start") - min_words))).otherwise(0)
    opens = F.coalesce((F.col("start") > F.lag("start").over(by_doc) + min_words).cast("int"), F.lit(1))
    spans = found.withColumn("adds", adds).withColumn("opens", opens).withColumn("span", F.sum("opens").over(by_doc))
    spans = spans.groupBy("doc_id", "text_key", "span").agg(F.min("start").cast("long").alias("start_word"), (F.max("start") + min_words).cast("long").alias("end_word"), F.sum("adds").cast("long").alias("n_later_words"), F.min("first_doc_id").alias("first_doc_id"))
    spans = materialize(spans, "spans")
    # equal texts: every copy but the first repeats it whole
    size = F.size(F.filter(F.split("text", _BLANK), lambda x: x != "")).cast("long")
    whole = texts.groups.where("n > 1").select("text_key", F.struct("doc_id").alias("first"), size.alias("end_word"), "n").where(F.col("end_word") >= min_words)
    known = spans.groupBy("text_key").agg(F.sum("n_later_words").alias("known_later"), F.min("first_doc_id").alias("known_first"))
    whole = materialize(whole.join(known, "text_key", "left"), "whole")
    # a large group of copies doesn't move to one task
    copies = join_counted(texts.all.select("doc_id", "text_key"), whole, ["text_key"]).distinct()
    is_first = F.struct("doc_id") == F.col("first")
    copies = copies.select(
        "doc_id",
        F.lit(0).cast("long").alias("start_word"),
        "end_word",
        F.when(is_first, F.coalesce("known_later", F.lit(0))).otherwise(F.col("end_word")).cast("long").alias("n_later_words"),
        F.least("known_first", "first.doc_id").alias("first_doc_id"),
    )
    alone = spans.join(whole.select("text_key"), "text_key", "left_anti").select(copies.columns)
    return alone.union(copies).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "n_later_words", "first_doc_id")
