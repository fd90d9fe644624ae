"""Token counts of whole texts by a map-side lookup in two tiers.

First tier: the lengths of frequent pieces, a table of at most ``table_size``
entries that is broadcast. It is fitted on a bounded sample, ``SAMPLE_ROWS`` texts
of at most ``SAMPLE_CHARS`` characters by a hash of the text, in one task that
tallies and encodes their pieces; no piece is shuffled, at any size of the corpus.
Second tier: a worker's own memory of pieces, filled by the tokenizers library in
batches. Both only save work: every text is counted whole and the counts are
exact whatever the tables hold.

Nulls: a null text has no bytes and no tokens. Repeated rows are counted each for
itself. Columns other than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_batches
from .pieces import encoder, split_pieces

#: Bounds of the sample that the table is fitted on, and the longest piece that the table has.
SAMPLE_ROWS, SAMPLE_CHARS, PIECE_CHARS = 2000, 100_000, 40


def frequent_pieces(docs: DataFrame, tokenizer: str, table_size: int = 1 << 16) -> tuple[bytes, list[int]]:
    """The most frequent pieces of the sample, joined by spaces, and their token counts: at most ``table_size * PIECE_CHARS`` characters."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(tokenizer), Counter()
        for b in batches:
            for text in b.column("text").to_pylist():
                seen.update((split_pieces(text, enc.specials) if enc.splits else None) or ())
        top = [p for p, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n > 1 and len(p) <= PIECE_CHARS][:table_size]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array([len(i) // enc.dtype.itemsize for i in enc.encode_pieces(top)], pa.int32())], names=["piece", "length"])

    text = F.col("text").cast("string")
    # by a threshold first, so that about four times the sample leave all tasks together, however many tasks there are
    share = min(1.0, 4 * SAMPLE_ROWS / max(docs.count(), 1))
    given = docs.select(text.alias("text"), F.xxhash64("doc_id", "text").alias("h")).where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
    sample = given.where((F.col("text") != "") & (F.char_length("text") <= SAMPLE_CHARS)).orderBy("h").limit(SAMPLE_ROWS).select("text")
    # a limit has one partition, so one task fits the whole table
    rows = sample.mapInArrow(fit, "piece string, length int").toArrow()
    return " ".join(rows.column("piece").to_pylist()).encode(), rows.column("length").to_pylist()


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, table_size: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(frequent_pieces(docs, tokenizer, table_size))
    key = uuid.uuid4().int & 0x7FFFFFFF

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, frequent = encoder(tokenizer, key), None
        for b in batches:
            if frequent is None:
                names, lengths = shared.value
                frequent = {} if enc.lengths else dict(zip(names.decode().split(" "), lengths, strict=True)) if lengths else {}
            n = pa.array(enc.count(b.column("text").to_pylist(), frequent), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length(F.col("text").cast("string")).cast("long"), F.lit(0)).alias("n_bytes"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
