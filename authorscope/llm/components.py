"""Connected components of an edge table, without a node's neighbours ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is named by its smallest node.

    Each round takes the smallest label among the neighbours, then the label of that label. Labels halve their distance
    to the smallest node, so rounds grow with the logarithm of the longest path. Every round is written, so a lost
    executor costs at most one round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = durable(both.where("a != b").distinct(), "edges")
    labels = durable(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = durable(
            labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "step"
        )
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = durable(step.join(jump, "label").select("node", F.col("far").alias("label"), (F.col("far") != F.col("old")).alias("moved")), "labels")
        if not labels.where("moved").limit(1).count():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
