"""Connected components by contraction."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, functions as F


def cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarryline-"))
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the least node of its component.

    Nodes are ordered by a hash, so that chains of neighbouring ids shrink as fast as any graph. In each round every node goes to its
    least neighbour's least neighbour, itself counted as one, and the graph is contracted; lineage is cut by checkpoints in the shared
    folder."""
    ranked = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    edges = cut(links.where("a <> b").select(ranked("a").alias("a"), ranked("b").alias("b")).distinct())
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        one = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("v"), F.least("a", "least").alias("p"))
        to = cut(one.join(one.select(F.col("v").alias("p"), F.col("p").alias("q")), "p").select("v", F.col("q").alias("p")))
        labels = cut(labels.join(to, F.col("label") == F.col("v"), "left").select("node", F.coalesce("p", "label").alias("label")))
        edges = edges.join(to.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(to.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        edges = cut(edges.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    least = labels.groupBy("label").agg(F.min("node.n").alias("least"))
    return labels.join(least, "label").select(F.col("node.n").alias("node"), F.col("least").alias("label"))
