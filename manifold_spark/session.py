"""Session helpers: reading tables, shared scratch space, cutting lineage and joins with hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables; ``sf_dir`` may be any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hadoop(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application inside the one that driver and executors share, ``spark.checkpoint.dir``.

    Only on a local master a temporary folder may take its place; elsewhere an
    unset folder is an error, as executors would each write to their own disk.
    The folder is deleted when the application ends.
    """
    found = spark.conf.get("manifold.scratch.dir", None)
    if not found:
        context = spark.sparkContext
        top = context.getConf().get("spark.checkpoint.dir")
        if not top:
            if not context.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="manifold-")
        found = f"{top.rstrip('/')}/manifold-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        spark.conf.set("manifold.scratch.dir", found)
        folder, store = _hadoop(spark, found)
        store.mkdirs(folder)
        store.deleteOnExit(folder)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the
    optimizer a file size to plan the following joins with.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`scratch_path` that no later plan reads."""
    folder, store = _hadoop(spark, path)
    store.delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound the rows and the bytes of an Arrow batch, so that a batch of long texts fits a Python worker.

    These are settings of the session; a larger bound than the given one is lowered, a smaller one stays.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if spark.conf.get(f"manifold.seen.{key}", None) is None:
            spark.conf.set(key, most)
            spark.conf.set(f"manifold.seen.{key}", "true")


#: A key is hot if it holds more than this share of the counted rows, so there are at most 2048 hot keys.
HOT_SHARE = 1 / 2048


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str = "n") -> DataFrame:
    """Inner join where ``right`` has each key once, with ``count``, the rows of ``left`` that hold it.

    Hot keys (at most ``1 / HOT_SHARE`` of them, by their share of the counts) are
    joined by a broadcast, which moves none of their many rows; all others by the
    usual shuffle. Both sides are read twice, so they should be tables.
    """
    least = right.agg(F.coalesce(F.sum(count), F.lit(0)).alias("all")).first()["all"] * HOT_SHARE
    hot = right.where(F.col(count) > F.lit(float(least)))
    names = hot.select(*on)
    cold = left.join(F.broadcast(names), on, "left_anti").join(right.where(F.col(count) <= F.lit(float(least))), on)
    return left.join(F.broadcast(hot), on).unionByName(cold)


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct, so that columns beside it can't clash with them; :func:`unpacked` undoes it."""
    return F.struct(*(df[f"`{c}`"] for c in df.columns)).alias(name)


def unpacked(df: DataFrame, columns: list[str], name: str = "row") -> DataFrame:
    """The columns of the input again."""
    return df.select(*(F.col(name).getField(c).alias(c) for c in columns))
