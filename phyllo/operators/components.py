"""Components of edge tables: connected ones, and those of a scan along directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phyllo.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node reachable.

    Every node has a parent, itself at first. A round looks at the grandparents of
    a node's neighbours: the smallest becomes the parent of the node and of its
    parent, and every node moves up to its own grandparent. So whole trees hook
    onto others at once, and long chains take few rounds. Labels meet through
    joins and pre-aggregated minima only: no neighbour list is ever gathered, and
    a hub's edges are split by the skew join. Every round is written to the shared
    folder. Rows with a null end are dropped; self-loops keep their node as a
    component of its own.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    both = cut(both.union(both.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("above"))
        grand = labels.join(up, F.col("component") == F.col("up")).select("node", "above")
        near = both.join(grand, F.col("b") == F.col("node")).groupBy("a").agg(F.min("above").alias("low"))
        hooked = near.join(labels, F.col("a") == F.col("node")).select(F.explode(F.array(F.col("a"), F.col("component"))).alias("node"), "low")
        lowered = hooked.unionByName(grand.withColumnRenamed("above", "low")).groupBy("node").agg(F.min("low").alias("component"))
        lowered = cut(lowered.join(labels.withColumnRenamed("component", "was"), "node"), "labels")
        moved = lowered.where(F.col("component") != F.col("was")).limit(1).count()
        labels = lowered.select("node", "component")
        if not moved:
            return labels


def smallest_reaching(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of ``edges``: the smallest node from which directed edges lead to it, itself included.

    These are the components of a scan that begins at every unvisited node in
    ascending order and walks along edges to unvisited nodes: whatever an earlier
    start reaches it has already visited, so a node falls to the smallest that
    reaches it at all. A round hands every node's label along its edges, and to
    each node the label of its label, so long chains take few rounds. Labels meet
    through joins and pre-aggregated minima. Rows with a null end are dropped.
    """
    ways = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna().distinct(), "ways")
    nodes = ways.select(F.col("a").alias("node")).union(ways.select("b")).distinct()
    labels = cut(nodes.withColumn("component", F.col("node")), "reached")
    while True:
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("above"))
        grand = labels.join(up, F.col("component") == F.col("up")).select("node", F.col("above").alias("low"))
        handed = ways.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("component").alias("low")).select(F.col("b").alias("node"), "low")
        lowered = grand.unionByName(handed).groupBy("node").agg(F.min("low").alias("component"))
        lowered = cut(lowered.join(labels.withColumnRenamed("component", "was"), "node"), "reached")
        moved = not lowered.where(F.col("component") != F.col("was")).isEmpty()
        labels = lowered.select("node", "component")
        if not moved:
            return labels
