"""Results to files: embeddings, further outputs, metric tables and a manifest, all through Spark's own writers.

A folder of outputs holds ``embeddings`` (csv with ``dim_i`` columns, json or
parquet), further tables by name, and ``manifest`` (json). Spark commits a table
as a whole, so a reader never sees half of one; the manifest is written last and
is what makes a folder complete.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def dimensions(points: DataFrame) -> int:
    first = points.select(F.size("vec").alias("d")).where("d > 0").first()
    return first["d"] if first else 0


def wide(points: DataFrame, prefix: str = "dim_", first: int = 1) -> DataFrame:
    """id and one column a dimension; other columns stay."""
    d = dimensions(points)
    return points.select("id", *(F.element_at("vec", i + 1).alias(f"{prefix}{i + first}") for i in range(d)), *(c for c in points.columns if c not in ("id", "vec")))


def narrow(table: DataFrame, prefix: str = "dim_") -> DataFrame:
    """id and vec again, columns in order of their number."""
    names = sorted((c for c in table.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix) :]))
    return table.select("id", F.array(*(F.col(c).cast("double") for c in names)).alias("vec"), *(c for c in table.columns if c != "id" and c not in names))


def save_embeddings(points: DataFrame, path: str, format: str = "parquet", prefix: str = "dim_") -> None:
    """Points as csv (a column a dimension), json or parquet."""
    if format == "csv":
        wide(points, prefix).write.mode("overwrite").csv(path, header=True)
    elif format in ("json", "parquet"):
        points.write.mode("overwrite").format(format).save(path)
    else:
        raise ValueError(f"no writer for {format}")


def load_embeddings(spark: SparkSession, path: str, format: str = "parquet", prefix: str = "dim_") -> DataFrame:
    if format == "csv":
        return narrow(spark.read.csv(path, header=True, inferSchema=True), prefix)
    return spark.read.format(format).load(path)


def manifest(outputs: dict[str, DataFrame], scores: dict[str, float] | None = None, metadata: dict | None = None) -> dict:
    """What a folder of outputs holds: shapes, scores and metadata, all as json can hold it."""
    points = outputs["embeddings"]
    return {
        "shape": [points.count(), dimensions(points)],
        "dtype": dict(points.dtypes)["vec"],
        "tables": {name: dict(t.dtypes) for name, t in outputs.items()},
        "scores": {k: float(v) for k, v in (scores or {}).items()},
        "metadata": metadata or {},
    }


def write_outputs(outputs: dict[str, DataFrame], folder: str, format: str = "parquet", scores: dict[str, float] | None = None, metadata: dict | None = None) -> dict:
    """Write all tables and then the manifest; ``embeddings`` must be among them."""
    if "embeddings" not in outputs:
        raise ValueError("outputs need embeddings")
    for name, table in outputs.items():
        if name == "embeddings":
            save_embeddings(table, f"{folder}/{name}", format)
        else:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
    said = manifest(outputs, scores, (metadata or {}) | {"format": format})
    spark = outputs["embeddings"].sparkSession
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return said


def load_outputs(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables and the manifest of a folder."""
    said = json.loads(spark.read.text(f"{folder}/manifest").first().value)
    tables = {name: load_embeddings(spark, f"{folder}/{name}", said["metadata"]["format"]) if name == "embeddings" else spark.read.parquet(f"{folder}/{name}") for name in said["tables"]}
    return tables, said


def write_step(points: DataFrame, folder: str, step: int, name: str) -> None:
    """Append one step of a run, as a partition of its own that a repeated write replaces."""
    table = points.withColumn("step", F.lit(step)).withColumn("step_name", F.lit(name))
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(folder)


def results_table(spark: SparkSession, results: dict[str, float]) -> DataFrame:
    """metric and value, a row a result."""
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(results.items())], "metric string, value double")


def score_tables(scores: DataFrame, samples: dict[str, DataFrame], ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row with a column a metric, and one row an id with a column a per-sample metric (tables of id and value), nulls where it has none."""
    names = [r.metric for r in scores.select("metric").distinct().orderBy("metric").collect()]
    scalars = scores.groupBy().pivot("metric", names).agg(F.first("value"))
    per_sample = ids.select("id")
    for name, t in samples.items():
        per_sample = per_sample.join(t.select("id", F.col("value").alias(name)), "id", "left")
    return scalars, per_sample


def snapshot(rows: DataFrame, version: int = 1) -> DataFrame:
    """A checked table of activations: sample_id, layer, vec and schema_version.

    Every sample has one row a layer, ids and layers aren't null, and the vectors
    of a layer have one length; anything else is an error.
    """
    by = rows.groupBy("layer").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("ids"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most"))
    bad = by.where("layer is null or n <> ids or least <> most or least < 1").take(1)
    sizes = by.agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    if bad or sizes["a"] != sizes["b"] or rows.where("sample_id is null").take(1):
        raise ValueError(f"not a snapshot: {bad or sizes}")
    return rows.select("sample_id", "layer", "vec", F.lit(version).alias("schema_version"))
