"""Iterations over graphs: lineage is cut in the folder that the session names, nothing is collected but a flag."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to ``spark.checkpoint.dir`` and read from there, so that lost executors cost one step and plans do
    not grow from round to round. Where the setting is missing: a folder of our own in local mode, an error on a cluster."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="chronoweave-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def components(edges: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, node, component) for every node of the edges, within each key: the component's smallest node.

    A round takes the smallest label among a node's neighbours, then that label's own label, so ways shorten by half."""
    one = edges.select(key, F.col(a).alias("a"), F.col(b).alias("b"))
    both = cut(one.unionByName(one.select(key, F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    labels = cut(both.groupBy(key, F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), [key, "b"]).groupBy(key, F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, [key, "node"]).select(key, "node", "component", F.least("component", "near").alias("low"))
        over = labels.select(key, F.col("node").alias("low"), F.col("component").alias("over"))
        after = F.least("low", F.coalesce("over", "low"))
        moved = cut(step.join(over, [key, "low"], "left").select(key, "node", after.alias("component"), (after != F.col("component")).alias("moved")))
        labels = moved.select(key, "node", "component")
        if not moved.filter("moved").head(1):
            return labels
