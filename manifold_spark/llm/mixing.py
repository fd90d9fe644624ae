"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Token weights are summed by cell (source, language, topic). The cells are raked:
each round scales them to the target shares of the sources, then of the
languages, then of the topics, until ``rounds`` are done or, looked at every
fourth round, all shares are within ``tolerance`` of their targets; ``residuals``
tells how far they are. A document's probability is its cell's scale divided by
the largest, so the expected tokens of the sample have the raked shares, and a
hash of doc_id and seed decides.

``targets`` gives weights of the values of a dimension, which are normalised;
values without one get weight 0 and their documents go. A dimension without
targets aims at its observed shares raised to a power (below 1 flattens).
A document's tokens are taken as a quarter of its characters, rounded up. The
topic is the column ``topic`` where there is one, else the text's form by the
first rule of ``TOPICS`` that fits, a stand-in for a topic model of the user's.

Nulls: a null source, language or topic is a value of its own, ``(null)``. A null
text has no tokens; cells without any tokens keep scale 0 and their documents go.
A null doc_id is drawn as if it were the text ``null``. Repeated rows are drawn
alike. An empty table gives an empty one. All columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, packed, unpacked

DIMENSIONS = ("source", "lang", "topic")
#: Power of the observed share that is aimed at.
POWERS = {"source": 0.9, "lang": 0.9, "topic": 0.95}
ROUNDS, SEED = 12, 20
#: Cells up to so many are raked in one partition; more are shuffled.
ONE_PARTITION = 100_000
TOPICS = (("licence", "licen[cs]e"), ("table", " [|] "), ("symbols", "[#*$%&]{3}"), ("shout", "!!"))


def topic(docs: DataFrame) -> Column:
    if "topic" in docs.columns:
        return F.col("topic").cast("string")
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(F.col("text").rlike(pattern), name).otherwise(out)
    return out


def tokens() -> Column:
    return F.ceil(F.coalesce(F.char_length("text"), F.lit(0)) / 4).cast("long")


def _dimensions(docs: DataFrame) -> list[Column]:
    named = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": topic(docs)}
    return [F.coalesce(named[d], F.lit("(null)")).alias(f"_{d}") for d in DIMENSIONS]


def _target(mine: DataFrame, d: str, targets: dict[str, dict[str, float]] | None, power: float) -> DataFrame:
    """Each value of a dimension with the share that it is to have."""
    if targets and d in targets:
        given = mine.sparkSession.createDataFrame([(k if k is not None else "(null)", float(w)) for k, w in targets[d].items()], f"_{d} string, p double")
        # weights of values that the corpus lacks can't be met and are left out
        weights = mine.join(given, f"_{d}", "left").withColumn("p", F.when(F.col("m") > 0, F.coalesce("p", F.lit(0.0))).otherwise(0.0))
    else:
        weights = mine.withColumn("p", F.when(F.col("m") > 0, F.pow("m", F.lit(power))).otherwise(0.0))
    return weights.withColumn(f"{d}_target", F.coalesce(F.try_divide(F.col("p"), F.sum("p").over(Window.partitionBy(F.lit(0)))), F.lit(0.0))).select(f"_{d}", f"{d}_target")


def residuals(cells: DataFrame) -> DataFrame:
    """dimension and residual: the largest distance of a value's share from its target."""
    all_ = Window.partitionBy(F.lit(0))
    out = None
    for d in DIMENSIONS:
        by = cells.groupBy(f"_{d}").agg(F.sum("w").alias("w"), F.first(f"{d}_target").alias("target"))
        one = by.select(F.abs(F.coalesce(F.try_divide(F.col("w"), F.sum("w").over(all_)), F.lit(0.0)) - F.col("target")).alias("r")).agg(F.lit(d).alias("dimension"), F.coalesce(F.max("r"), F.lit(0.0)).alias("residual"))
        out = one if out is None else out.union(one)
    return out


def raked(docs: DataFrame, rounds: int = ROUNDS, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None, tolerance: float = 0.0) -> DataFrame:
    """The cells: _source, _lang, _topic, their tokens, scale (raked over observed tokens), weights ``w`` and targets."""
    cells = materialize(docs.select(*_dimensions(docs), tokens().alias("t")).groupBy(*(f"_{d}" for d in DIMENSIONS)).agg(F.sum("t").alias("tokens")), "cells")
    # a checked size: the usual handful of cells needs no shuffle, and any more are dealt out
    small = cells.count() <= ONE_PARTITION
    if small:
        cells = cells.coalesce(1)
    for d in DIMENSIONS:
        mine = cells.groupBy(f"_{d}").agg(F.sum("tokens").cast("double").alias("m"))
        cells = cells.join(_target(mine, d, targets, powers[d]), f"_{d}")
    cells = materialize(cells.withColumn("w", F.col("tokens").cast("double")), "targets")
    grand = cells.agg(F.sum("w")).first()[0] or 0.0
    for at in range(rounds):
        if small:
            cells = cells.coalesce(1)
        for d in DIMENSIONS:
            have = F.sum("w").over(Window.partitionBy(f"_{d}"))
            cells = cells.withColumn("w", F.when(F.col("w") > 0, F.col("w") * F.col(f"{d}_target") * F.lit(float(grand)) / have).otherwise(0.0))
        if at % 4 == 3:
            cells = materialize(cells, "raked")
            if tolerance and residuals(cells).agg(F.max("residual")).first()[0] <= tolerance:
                break
    scale = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)
    return cells.select(*(f"_{d}" for d in DIMENSIONS), "tokens", scale.alias("scale"), "w", *(f"{d}_target" for d in DIMENSIONS))


def uniform(seed: int) -> Column:
    """A number in [0, 1) from the doc_id."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def with_probability(docs: DataFrame, rounds: int = ROUNDS, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None, tolerance: float = 0.0) -> DataFrame:
    """row (the document's columns), doc_id, its cell (``_source``, ``_lang``, ``_topic``) and ``probability``."""
    cells = materialize(raked(docs, rounds, powers, targets, tolerance), "scales")
    largest = cells.agg(F.max("scale")).first()[0] or 1.0
    cells = cells.select(*(f"_{d}" for d in DIMENSIONS), (F.col("scale") / F.lit(float(largest))).alias("probability"))
    return docs.select(packed(docs), F.col("doc_id"), *_dimensions(docs)).join(cells, [f"_{d}" for d in DIMENSIONS])


def mix(docs: DataFrame, seed: int = SEED, targets: dict[str, dict[str, float]] | None = None, tolerance: float = 0.0) -> DataFrame:
    """The sampled documents, with their columns."""
    return unpacked(with_probability(docs, targets=targets, tolerance=tolerance).where(uniform(seed) < F.col("probability")), docs.columns)


def sample(docs: DataFrame, seed: int = SEED, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """doc_id, source, lang, topic and probability of each sampled document."""
    given = docs.select("doc_id", "text", "source", "lang", *(["topic"] if "topic" in docs.columns else []))
    drawn = with_probability(given, targets=targets).where(uniform(seed) < F.col("probability"))
    return drawn.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.round("probability", 6).alias("probability"))


def oracle(rounds: int = ROUNDS, powers: dict[str, float] = POWERS, seed: int = SEED) -> str:
    """The same in SQL: each round and dimension a step of its own."""
    rules = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    steps = [
        f"""docs AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang, CASE {rules} ELSE 'prose' END AS topic, CAST(ceil(coalesce(length(text), 0) / 4.0) AS BIGINT) AS t FROM documents)""",
        "cells AS (SELECT source, lang, topic, CAST(sum(t) AS DOUBLE) AS tokens FROM docs GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        steps.append(f"m_{d} AS (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {powers[d]}) ELSE 0 END AS p FROM cells GROUP BY {d})")
        steps.append(f"t_{d} AS (SELECT {d}, p / sum(p) OVER () AS share FROM m_{d})")
    steps.append("s0 AS (SELECT *, tokens AS w, sum(tokens) OVER () AS grand FROM cells)")
    n = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            steps.append(f"s{n + 1} AS MATERIALIZED (SELECT s.source, s.lang, s.topic, tokens, grand, CASE WHEN w > 0 THEN w * share * grand / sum(w) OVER (PARTITION BY s.{d}) ELSE 0 END AS w FROM s{n} s JOIN t_{d} t ON s.{d} = t.{d})")
            n += 1
    steps.append(f"scales AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS scale FROM s{n})")
    steps.append("chances AS (SELECT source, lang, topic, scale / (SELECT max(scale) FROM scales) AS probability FROM scales)")
    number = f"CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{seed}'), 1, 12)) AS BIGINT) / {float(1 << 48)}"
    return f"WITH {', '.join(steps)} SELECT doc_id, d.source, d.lang, d.topic, round(probability, 6) AS probability FROM docs d JOIN chances c ON d.source = c.source AND d.lang = c.lang AND d.topic = c.topic WHERE {number} < probability"
