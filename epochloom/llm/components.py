"""Connected components of a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from epochloom.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of ``a, b`` links; a component is named by its smallest node.

    Each round takes the smallest label around a node and then the label of that label, so chains halve.
    Labels of a round are minima that Spark combines before the shuffle; no group is ever collected.
    Nothing else than one count a round comes to the driver. An edge table without rows gives none.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        around = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        near = labels.join(around, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        # the label's own label, as of the round before
        far = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        moved = saved(near.join(far, "to", "left").select("node", F.least("to", "beyond").alias("component"), "was"), "labels")
        if moved.filter("component <> was").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")
