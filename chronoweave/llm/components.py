"""Connected components of a graph in two columns, by joins; nothing of it comes to the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the smallest node of its component.

    Each round a node takes the smallest label among its neighbours' and then that label's own label, so chains
    shorten by half or more; the labels of each round are a written table.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}-0")
    k = 0
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("above"))
        after = scratch.save(step.join(up, "low", "left").select("node", F.least("low", F.coalesce("above", "low")).alias("label"), (F.least("low", F.coalesce("above", "low")) != F.col("label")).alias("moved")), f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}")
        k += 1
        labels = after.select("node", "label")
        if not after.filter("moved").head(1):
            scratch.drop(f"{name}-edges")
            return labels
