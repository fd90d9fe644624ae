"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is the bag of the character n-grams (3 to 6, with word edges) of its
words; each n-gram hashes to a row of an embedding matrix, the rows are averaged
and a linear softmax gives the classes. Embeddings and softmax are trained
together in numpy by Adagrad on a bounded sample of labelled rows: at most
``max_rows`` of each class, taken by a hash of doc_id, in one task. A misspelt
word keeps most of its n-grams, and with them its vectors.

Scoring needs one number for each bucket, the difference of the classes' logits,
so what is broadcast has a fixed size (4 bytes a bucket).

Nulls: a null or blank text has no n-grams and gets the score of the bias, capped
below 0.5, as nothing in it is toxic. A null doc_id counts as held out. Labels:
of repeated labels of a doc_id the largest counts; null labels teach nothing.
Without rows of both classes every score is the share of toxic labels, at most
0.5 less a little. Repeated rows are scored each for itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small_batches
from .words import mix

BUCKETS, WIDTH, SIZES = 1 << 17, 8, (3, 4, 5, 6)
_R = np.uint64(0x9E3779B97F4A7C15)
_EDGES = str.maketrans("<>", "  ")


def grams(text: str | None) -> np.ndarray:
    """Buckets of all character n-grams of a text's words."""
    words = (text or "").lower().translate(_EDGES).split()
    if not words:
        return np.empty(0, np.int64)
    c = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    word = np.cumsum(c == ord("<"))
    h, out = c * _R, []
    for n in range(2, SIZES[-1] + 1):
        if len(c) < n:
            break
        h = h[:-1] * _R + c[n - 1 :]
        if n in SIZES:
            out.append((mix(h[word[: len(h)] == word[n - 1 :]] + np.uint64(n)) >> np.uint64(47)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _batch(bags: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """A batch as a sparse matrix: its rows, the buckets that it has, and document, place and share of every entry."""
    bucket, place = np.unique(np.concatenate([x for x, _ in bags]), return_inverse=True)
    doc = np.repeat(np.arange(len(bags), dtype=np.int32), [len(x) for x, _ in bags])
    return rows, bucket.astype(np.int32), doc, place.astype(np.int32), np.concatenate([x for _, x in bags])


def train(texts: list[str | None], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.6, seed: int = 1) -> tuple[np.ndarray, float]:
    """Logit difference of each bucket, and the bias."""
    rng = np.random.default_rng(seed)
    bags = []
    for t in texts:
        b, n = np.unique(grams(t), return_counts=True)
        bags.append((b, (n / max(n.sum(), 1)).astype(np.float32)))
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    w, bias = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    ge, gw, gb = np.full(BUCKETS, 1e-8, np.float32), np.full(w.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    sizes = np.maximum(np.bincount(labels, minlength=2), 1)
    cost = (len(labels) / (2 * sizes))[labels].astype(np.float32) ** 0.5
    # batches are dealt once, so that their grams are sorted once; epochs only shuffle the batches
    filled = rng.permutation([i for i in range(len(bags)) if len(bags[i][0])])
    dealt = [_batch([bags[i] for i in rows], rows) for rows in np.split(filled, range(batch, len(filled), batch)) if len(rows)]
    del bags
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.02
        for at in rng.permutation(len(dealt)):
            rows, bucket, doc, place, v = dealt[at]
            # a batch's matrix is at most batch x BUCKETS; as a dense one its products run in BLAS
            share = np.zeros((len(rows), len(bucket)), np.float32)
            share[doc, place] = v
            mean = share @ e[bucket]
            z = mean @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p *= cost[rows][:, None]
            dw, db, dm = mean.T @ p / len(rows), p.mean(axis=0), (p @ w.T).astype(np.float32)
            gw += dw**2
            gb += db**2
            w -= (0.1 * step * dw / np.sqrt(gw)).astype(np.float32)
            bias -= (0.1 * step * db / np.sqrt(gb)).astype(np.float32)
            de = share.T @ dm
            ge[bucket] += (de**2).sum(axis=1)
            e[bucket] -= (step * de / np.sqrt(ge[bucket])[:, None]).astype(np.float32)
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> tuple[np.ndarray, float]:
    """Train on at most ``max_rows`` labelled rows of each class that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).withColumn("order", F.xxhash64("doc_id"))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy("order", "doc_id").limit(max_rows)
        chosen = part if chosen is None else chosen.union(part)
    chosen = materialize(chosen.select("doc_id", "toxic"), "labelled")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # of repeated rows one; the sample is bounded, so one task holds it
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("row")).select("doc_id", "row.*")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        y = pdf["toxic"].to_numpy(np.int64)
        share = float(y.mean()) if len(y) else 0.0
        if share in (0.0, 1.0):
            return pd.DataFrame([{"weights": np.zeros(BUCKETS, np.float32).tobytes(), "bias": float(np.log((min(share, 0.49) + 1e-3) / (1 - min(share, 0.49))))}])
        weights, bias = train(pdf["text"].to_list(), y)
        return pd.DataFrame([{"weights": weights.tobytes(), "bias": bias}])

    rows = materialize(sample.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, "weights binary, bias double"), "toxicity-model").collect()
    if not rows:
        return np.zeros(BUCKETS, np.float32), float(np.log(1e-3))
    return np.frombuffer(rows[0].weights, np.float32), rows[0].bias


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for b in batches:
            z = np.empty(b.num_rows)
            for i, text in enumerate(b.column("text").to_pylist()):
                g = grams(text)
                z[i] = bias + float(weights[g].mean(dtype=np.float64)) if len(g) else min(bias, -1e-3)
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (rest == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> DataFrame:
    """Train on the labelled rows, score every document."""
    return score(docs, fit(docs, labels, max_rows))
