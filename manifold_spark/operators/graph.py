"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of an edge table by the smallest node that it is connected with: node, component.

    Each round takes the smallest label among the neighbours and then follows
    labels of labels, so that long chains halve; aggregation is partial before
    each shuffle, so a hub with many edges loads no single task. Every round is
    written to the shared folder. Nulls and self-edges are ignored.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = materialize(e.union(e.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        low = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("far"))
        step = low.join(jump, "low").select("node", "was", F.least("low", "far").alias("component"))
        step = materialize(step, "labels")
        labels = step.select("node", "component")
        if not step.where("component <> was").take(1):
            return labels
