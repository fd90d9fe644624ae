"""Point tables, labels and metadata from files: csv, tsv, npy, npz, json, jsonl and parquet.

Every reader gives ``id`` (the row's place in the file or channel) and ``vec``.
Text formats are read by Spark's own readers; ``.npy`` and ``.npz`` come through
``binaryFile``, a file a row, and are cut into rows inside tasks. Rows of a text
file get their place from the order of the scan: partitions are counted, and each
row adds the sum of those before.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sampling import uniform
from ..session import materialize

SEPARATORS = ",\t;| "


def detect_separator(spark: SparkSession, path: str, sample: int = 1024) -> str:
    """The separator of a text table, from the first ``sample`` characters; a comma where nothing tells."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(20).collect())[:sample]
    try:
        return csv.Sniffer().sniff(head, SEPARATORS).delimiter
    except csv.Error:
        return ","


def has_header(spark: SparkSession, path: str, sep: str) -> bool:
    """Whether the first line holds something that is no number."""
    first = spark.read.text(path).limit(1).collect()

    def number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    return bool(first) and not all(number(x) for x in first[0].value.split(sep))


def load_metadata(spark: SparkSession, path: str, required: list[str] | None = None, sep: str | None = None, processing=None) -> DataFrame:
    """A csv, tsv or parquet table with trimmed column names; a missing required column is an error."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.csv(path, sep=sep or ("\t" if path.endswith(".tsv") else detect_separator(spark, path)), header=True, inferSchema=True)
    df = df.toDF(*(c.strip() for c in df.columns))
    missing = [c for c in required or [] if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: columns {missing} are missing")
    return processing(df) if processing else df


def with_row_number(df: DataFrame, name: str = "id") -> DataFrame:
    """The rows with their place in the order of the scan, from 0.

    One row a partition is summed, so no row moves. The rows are written first,
    so that both readings see the same partitions.
    """
    table = materialize(df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = table.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return table.join(F.broadcast(before), "__part").select((F.col("__before") + F.col("__at")).alias(name), *df.columns)


def read_csv_points(spark: SparkSession, path: str, label_col: str | None = None, sep: str | None = None) -> DataFrame:
    """id, vec (all number columns in order) and label; labels that are no number count as 0."""
    sep = sep or detect_separator(spark, path)
    df = spark.read.csv(path, sep=sep, header=has_header(spark, path, sep), inferSchema=True)
    df = df.toDF(*(c.strip() for c in df.columns))
    vec = F.array(*(F.col(f"`{c}`").cast("double") for c in df.columns if c != label_col)).alias("vec")
    label = [F.coalesce(F.expr(f"try_cast(`{label_col}` AS DOUBLE)"), F.lit(0.0)).alias("label")] if label_col else []
    return with_row_number(df.select(vec, *label))


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """file, id and vec of all rows of the ``.npy`` files of a path or pattern; arrays of one dimension have rows of one number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                x = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                x = x.reshape(len(x), -1).astype(np.float64) if x.ndim else x.reshape(1, 1).astype(np.float64)
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float64()))], names=["file", "id", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "file string, id long, vec array<double>")


def read_npz_traces(spark: SparkSession, path: str, key: str = "pooled_steps", layer: int = -1) -> DataFrame:
    """trace, step and vec of ``.npz`` files, a trace a file in order of their names; arrays (steps, layers, d) give one layer."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                with np.load(io.BytesIO(content.as_py()), allow_pickle=False) as z:
                    x = np.asarray(z[key], np.float64)
                x = x[:, layer] if x.ndim == 3 else x
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(x)), pa.array(np.arange(len(x))), pa.array(list(x), pa.list_(pa.float64()))], names=["file", "step", "vec"])

    files = spark.read.format("binaryFile").load(path)
    # one row a file is numbered
    number = files.select(F.col("path").alias("file")).withColumn("trace", F.row_number().over(Window.orderBy("file")).cast("long") - 1)
    return files.select("path", "content").mapInArrow(rows, "file string, step long, vec array<double>").join(F.broadcast(number), "file").select("trace", "step", "vec")


def read_precomputed(spark: SparkSession, path: str, label_col: str | None = None) -> DataFrame:
    """id, vec (and label) of one ``.npy``, ``.csv``, ``.tsv`` or ``.parquet`` file."""
    if path.endswith(".npy"):
        return read_npy(spark, path).select("id", "vec")
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv_points(spark, path, label_col)


def channel_of(file: str) -> str:
    """The channel of a file of a directory: what stands behind the last ``_`` of its stem."""
    return file.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0].rsplit("_", 1)[-1]


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """channel, id and vec of all ``.npy`` files of a directory."""
    stem = F.regexp_extract("file", r"([^/]*)\.npy$", 1)
    return read_npy(spark, f"{path.rstrip('/')}/*.npy").select(F.element_at(F.split(stem, "_"), -1).alias("channel"), "id", "vec")


def join_channels(channels: dict[str, DataFrame]) -> DataFrame:
    """id and vec: the vectors of all channels one after another. Channels with other ids than the first are an error."""
    tables = list(channels.items())
    sizes = {name: t.count() for name, t in tables}
    out = tables[0][1].select("id", F.col("vec").alias("v0"))
    for i, (_, t) in enumerate(tables[1:], 1):
        out = out.join(t.select("id", F.col("vec").alias(f"v{i}")), "id")
    out = materialize(out.select("id", F.concat(*(f"v{i}" for i in range(len(tables)))).alias("vec")), "channels")
    if len({*sizes.values(), out.count()}) > 1:
        raise ValueError(f"channels have different rows: {sizes}")
    return out


def split(df: DataFrame, test: float, id_col: str = "id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows: exactly ``int(rows * test)`` of the least hashes of id are the test."""
    n = int(df.count() * test)
    if n == 0:
        return df, df.limit(0)
    # the n-th hash decides, so rows stay where they are
    cut = df.select(uniform(id_col, seed).alias("u"), F.col(id_col).alias("i")).orderBy("u", "i").limit(n).agg(F.max(F.struct("u", "i")).alias("last")).first()["last"]
    inside = F.struct(uniform(id_col, seed).alias("u"), F.col(id_col).alias("i")) <= F.struct(F.lit(cut["u"]).alias("u"), F.lit(cut["i"]).alias("i"))
    return df.where(~inside), df.where(inside)


#: Columns that may hold the points of a table, the first that it has being taken.
POINT_COLUMNS = ("precomputed", "raw", "data", "embeddings", "vec")


def points_column(df: DataFrame) -> str:
    """The column that holds the points: the first of POINT_COLUMNS, else the first array column."""
    for c in POINT_COLUMNS:
        if c in df.columns:
            return c
    for name, kind in df.dtypes:
        if kind.startswith("array"):
            return name
    raise ValueError("no column holds points")


def read_text_rows(spark: SparkSession, path: str, text_col: str = "text", limit: int | None = None) -> DataFrame:
    """The rows of json lines (compressed or not) whose text isn't blank; ``limit`` takes so many of the least hashes."""
    rows = spark.read.json(path).where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "")
    return rows.orderBy(F.xxhash64(text_col), text_col).limit(limit) if limit is not None else rows


def tokenized(rows: DataFrame, tokenize, max_length: int, text_col: str = "text", pad: int = 0) -> DataFrame:
    """The rows with ``input_ids`` and ``attention_mask``, cut and padded to ``max_length``; ``tokenize`` takes a list of texts and gives lists of ids."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        return pd.Series([list(x)[:max_length] for x in tokenize(texts.tolist())])

    blank = F.trim(F.coalesce(F.col(text_col), F.lit(""))) == ""
    out = rows.where(~blank).withColumn("input_ids", ids(F.col(text_col)))
    n = F.size("input_ids")
    return out.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), max_length - n))).withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad), max_length - n)))


def admixture(spark: SparkSession, folder: str, ids_train: str, ids_test: str, metadata: DataFrame, ks: range, prefix_train: str, prefix_test: str, id_col: str = "ID") -> DataFrame:
    """k, the id, component proportions and the metadata, of ``<prefix>.<k>.Q`` files whose rows stand in the order of the id lists; rows without metadata or with a null go."""
    out = None
    for k in ks:
        both = None
        for ids, prefix in ((ids_train, prefix_train), (ids_test, prefix_test)):
            q = spark.read.text(f"{folder}/{prefix}.{k}.Q").select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")).alias("q"))
            names = spark.read.text(ids).select(F.trim("value").alias(id_col))
            one = with_row_number(names, "place").join(with_row_number(q, "place"), "place").drop("place")
            both = one if both is None else both.unionByName(one)
        joined = both.withColumn("k", F.lit(k)).join(metadata, id_col)
        out = joined if out is None else out.unionByName(joined)
    return out.na.drop()
