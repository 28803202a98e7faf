"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import kept


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b): root is the smallest node
    reachable.  Each round takes the smallest root among a node's neighbours,
    then the root of that root; a round's result is checkpointed, and rounds
    end when nothing changes.  No group of links meets in one task: minima are
    pre-aggregated, joins are left to adaptive skew splitting."""
    edges = kept(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = kept(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        step = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        step = kept(step.join(jump, "next", "left").select("node", "root", F.least("next", F.coalesce("far", "next")).alias("next")))
        labels = step.select("node", F.col("next").alias("root"))
        if step.filter("root <> next").isEmpty():
            return labels
