"""Connected components of a graph that is only ever held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, scratch) -> DataFrame:
    """(``node``, ``component``) for every node of ``edges`` (``a``, ``b``); a component is named by its least node.

    Every node takes the least label among its own and its neighbours', and
    then that label's own label, until none changes. ``scratch(df)`` writes a
    table to the shared folder and reads it back; it holds one row for each
    node or edge.
    """
    both = scratch(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = scratch(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("component")
    ))
    while True:
        near = (
            both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        )
        taken = labels.join(near, labels.node == near.a, "left").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("now")
        )
        taken = scratch(taken)
        own = taken.select(F.col("node").alias("label"), F.col("now").alias("of_label"))
        jumped = taken.join(own, taken.now == own.label, "left").select(
            "node", "was", F.least("now", "of_label").alias("component")
        )
        jumped = scratch(jumped)
        labels = jumped.select("node", "component")
        if jumped.where("was <> component").isEmpty():
            return labels
