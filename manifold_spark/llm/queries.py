"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import read_table
from . import line_dedup, mixing, substring_dedup


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_records import token_records

    return token_records(spark, read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op6_tiktoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiktoken_bpe import round_trip

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .permutation_index import search

    return search(read_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import sample

    return sample(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(read_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import components

    return components(read_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeats

    return repeats(read_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import report

    return report(read_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import report

    return report(read_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_alignment import report

    return report(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import report

    return report(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_records,
        op2_toxicity,
        op3_permutation_index,
        op4_source_mixing,
        op5_quality_rules,
        op6_tiktoken,
        op7_jaccard_join,
        op8_suffix_dedup,
        op9_line_dedup,
        op10_token_counts,
        op11_substring_dedup,
        op12_token_alignment,
        op13_whitening,
    )
}
ORACLES = {"op4_source_mixing": mixing.oracle(), "op9_line_dedup": line_dedup.ORACLE, "op11_substring_dedup": substring_dedup.ORACLE}
