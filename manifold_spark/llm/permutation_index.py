"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots, the first ``prefix``
of ``pivots``. Candidates are dealt over blocks; a block posts its vectors in one
inverted file for each pivot, entries carrying the pivot's place. A query walks
the files of its own pivots and sums place differences, with ``prefix`` for a
pivot that is missing on one side: Spearman's footrule on prefixes. The best
``share`` of each block by footrule, ties included, is reranked by the exact
cosine, and the nearest of all blocks are the result.

Pivots are a bounded sample (the first ``pivots`` distinct vectors by hash);
every vector is indexed. Blocks and chunks of queries have bounded sizes, so a
task never holds more than one of each.

Nulls: vectors that are null, empty, zero, of another length than most or that
hold null or non-finite values take no part; rows without vec_id neither.
Repeated vec_ids are candidates each for itself, but a query never finds its own
id; a repeated query id is asked once (its least vector). With fewer candidates
than ``k`` all are returned; ties go to the smaller vec_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BLOCK, CHUNK = 8192, 1024


def valid(vectors: DataFrame, dim: int | None = None) -> tuple[DataFrame, int]:
    """vec_id and the vector as doubles, of rows that can take part; and the dimension."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    if dim is None:
        sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        dim = sizes[0].n if sizes else 1
    return v.where(F.size("v") == dim), dim


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each unit vector, nearest first."""
    d = -(x @ pivots.T)
    near = np.argpartition(d, prefix - 1, axis=1)[:, :prefix] if prefix < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)


def search_block(cid: np.ndarray, c: np.ndarray, qid: np.ndarray, q: np.ndarray, pivots: np.ndarray, prefix: int, share: float, k: int) -> pd.DataFrame:
    """The nearest of one block for each query of one chunk."""
    cu, qu = unit(c), unit(q)
    prefix = min(prefix, len(pivots))
    places = orders(cu, pivots, prefix)
    # the inverted files: entries in order of pivot, with the place that the pivot has
    flat = places.ravel()
    by_pivot = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))
    who, place = by_pivot // prefix, (by_pivot % prefix).astype(np.int32)
    # a pivot on one side only costs prefix - place; start from all of those and correct what is met
    alone = prefix * (prefix + 1) // 2
    wanted = min(len(cid), max(k + 1, int(np.ceil(share * len(cid)))))
    out = []
    for i, own in enumerate(orders(qu, pivots, prefix)):
        far = np.full(len(cid), 2 * alone, np.int32)
        for at, p in enumerate(own):
            a, b = starts[p], starts[p + 1]
            met = place[a:b]
            far[who[a:b]] += np.abs(met - at) - (prefix - met) - (prefix - at)
        cut = np.partition(far, wanted - 1)[wanted - 1]
        near = np.flatnonzero((far <= cut) & (cid != qid[i]))
        # row by row in one order, so that equal vectors have equal scores
        score = (cu[near] * qu[i]).sum(axis=1)
        best = np.lexsort((cid[near], -score))[:k]
        out.append(pd.DataFrame({"query_id": qid[i], "vec_id": cid[near][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(vectors: DataFrame, is_query, k: int = 5, pivots: int = 384, prefix: int = 64, share: float = 0.25) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each row where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows, _ = valid(vectors)
    rows = materialize(rows, "vectors")
    first = rows.select("v").groupBy(F.xxhash64("v").alias("h")).agg(F.first("v").alias("v")).orderBy("h").limit(pivots).collect()
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(unit(np.array([r.v for r in first])))
    asked = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    blocks, chunks = max(1, -(-rows.count() // BLOCK)), max(1, -(-asked.count() // CHUNK))
    # every block meets every chunk: the stated queries against all rows
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("chunk", cells(chunks))
    queries = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")).withColumn("block", cells(blocks))

    def compare(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return search_block(c["vec_id"].to_numpy(), np.stack(c["v"].to_list()), q["query_id"].to_numpy(), np.stack(q["q"].to_list()), shared.value, prefix, share, k)

    found = candidates.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInPandas(compare, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
