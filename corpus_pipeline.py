"""A corpus pipeline of five stages; each takes what the stage before it kept.

Quality rules drop what they reject; line dedup deletes every later copy of a
line; of each group of near-duplicates one document stays; sources, languages
and topics are mixed to their target weights; the last stage encodes the texts
and reports the ids and the bytes that they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from manifold_spark.llm import jaccard_join, line_dedup, mixing, quality_rules, tiktoken_bpe
from manifold_spark.session import materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, window=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiktoken_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("source mixing", mixture), ("byte-level BPE", encoding)]

#: Perplexities, similarity components and merges have no SQL. Tests hold the line and near-duplicate stages against
#: SQL or listed results (null ids, repeated ids with other texts, repeated rows); no test calls run() as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
