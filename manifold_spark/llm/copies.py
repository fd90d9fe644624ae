"""The distinct texts of a table, without shuffling the texts that occur once.

Which texts occur twice or more is told by a bitmap of fixed size over a 64-bit
key of the text. Rows that hit it (and a few more, by false hits) are grouped by
the key, with one copy of the text a task; all others are read where they stand.
A fuller bitmap costs work, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SLOTS = 1 << 27


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of SLOTS bits over the column ``key``; at most SLOTS / 64 rows come to the driver."""
    slot = keys.select(F.pmod("key", F.lit(SLOTS)).alias("slot"))
    words = slot.groupBy(F.expr("cast(slot div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(SLOTS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = (keys.astype(np.uint64) & np.uint64(SLOTS - 1)).astype(np.int64)
    return bits[slot >> 6] >> (slot & 63) & 1 == 1


class DistinctTexts:
    """``rows`` has ``text``, ``text_key`` and the columns of ``order``, whose least values stand for a group of copies."""

    def __init__(self, rows: DataFrame, order: list[str]):
        self.all, self.order = rows.select(*order, "text", "text_key"), order
        spark = rows.sparkSession
        self.copied = copied = spark.sparkContext.broadcast(bitmap(rows.groupBy(F.col("text_key").alias("key")).count().where("count > 1")))

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(hits(copied.value, b.column("text_key").to_numpy())))

        # texts that occur once may be among these by a false hit, and then are groups of one
        groups = self.all.mapInArrow(some, self.all.schema).groupBy("text_key").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"), F.first("text").alias("text"))
        self.groups = materialize(groups.select("first.*", "text", "text_key", "n"), "copies")

    def each(self, work, schema: str, tasks: int | None = None) -> DataFrame:
        """``work`` (iterator of batches -> iterator of batches) over every distinct text once, in at most ``tasks`` tasks if given."""
        copied = self.copied

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                raw = b.column("raw").to_numpy(zero_copy_only=False)
                b = b.filter(pa.array(~(raw & hits(copied.value, b.column("text_key").to_numpy()))))
                if b.num_rows:
                    yield b

        both = self.all.withColumn("raw", F.lit(True)).union(self.groups.select(*self.order, "text", "text_key", F.lit(False)))
        if tasks:
            both = both.coalesce(tasks)
        return both.mapInArrow(lambda batches: work(once(batches)), schema)
