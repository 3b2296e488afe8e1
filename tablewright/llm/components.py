"""Connected components of a link table, by smallest labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node in ``links(a, b)``; the root is the component's smallest node.

    Each round gives a node the smallest label among its neighbours, then the label of its label,
    so labels travel ever longer ways.  Labels are stored after each round: a lost executor costs
    no more than one round, and the joins, between two stored tables, leave a root that many nodes
    share to adaptive execution, which splits it.  Links have to be of bounded degree or spread.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both.filter("a != b"), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(near.withColumnRenamed("a", "node"), "node", "left")
        moved = stored(moved.select("node", "root", F.least("root", "near").alias("next")), "labels-near")
        jump = moved.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = moved.join(jump, "next", "left").select("node", "root", F.least("next", "far").alias("next"))
        after = stored(after, "labels-far")
        changed = after.filter("root != next").limit(1).count()
        labels = after.select("node", F.col("next").alias("root"))
        if not changed:
            return labels
