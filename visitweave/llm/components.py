"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitweave.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Each round offers a component the smallest label next to any of its nodes and then halves
    the way to the smallest node, so long chains take few rounds.  Every round is stored.
    """
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        theirs = labels.select(F.col("node").alias("b"), F.col("component").alias("next"))
        near = both.join(theirs, "b").groupBy(F.col("a").alias("node")).agg(F.min("next").alias("next"))
        offers = labels.join(near, "node").groupBy("component").agg(F.min("next").alias("next"))
        hooked = durable(labels.join(offers, "component").select(
            "node", "component", F.least("component", "next").alias("hooked")))
        jump = hooked.select(F.col("node").alias("hooked"), F.col("hooked").alias("further"))
        after = durable(hooked.join(jump, "hooked", "left").select(
            "node", F.coalesce("further", "hooked").alias("component"),
            (F.coalesce("further", "hooked") != F.col("component")).alias("moved")))
        labels = after.select("node", "component")
        if after.filter("moved").isEmpty():
            return labels
