"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def relabelled(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``rows`` with the component in place of each node in ``column``; nodes without one stay."""
    found = labels.select(F.col("node").alias(column), F.col("component").alias("_component"))
    return rows.join(found, column, "left").withColumn(column, F.coalesce("_component", column)).select(*rows.columns)


def settled(up: DataFrame) -> DataFrame:
    """up: node, component (a smaller node). Follows the pointers to their ends, twice as far each round."""
    while True:
        below = up.select(F.col("node").alias("component"), F.col("component").alias("lower"))
        if up.join(below, "component", "left_semi").isEmpty():
            return up
        up = checkpointed(up.join(below, "component", "left").select("node", F.coalesce("lower", "component").alias("component")))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable over ``edges`` (a, b), for nodes that are not the smallest themselves.

    Every node with a smaller neighbour points to the smallest one. The pointers form trees,
    whose roots take in their trees; then only edges between different roots are left, each
    once, and the next round joins these. A star is done in one round. So an edge is read
    once at full size, and a node has one pointer however many edges it has. Nothing but
    whether rows are left comes to the driver. Edges with a null end and loops join nothing.
    """
    ends = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    links = checkpointed(ends.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("a <> b").distinct())
    labels = None
    while labels is None or not links.isEmpty():
        roots = settled(checkpointed(links.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("component"))))
        labels = roots if labels is None else checkpointed(relabelled(labels, "component", roots).unionByName(roots))
        ends = relabelled(relabelled(links, "high", roots), "low", roots)
        links = checkpointed(ends.select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low")).where("high <> low").distinct())
    return labels
