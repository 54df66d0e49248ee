"""Nodes and records of trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imagelake.sources.tables import checkpoint_table


def reachable(edges: DataFrame, roots: list[int]) -> DataFrame:
    """(node, depth) of all nodes that roots reach over edges (node, child), level by level; a node counts at its first level.

    The walk goes on until a level brings no new node, so any depth is reached and a cycle in a corrupt image ends. The
    edges and each level are stored in the checkpoint folder.
    """
    edges = checkpoint_table(edges.select("node", "child"))
    level = edges.sparkSession.createDataFrame([(r,) for r in roots], "node long").withColumn("depth", F.lit(0))
    every, depth = level, 0
    while True:
        depth += 1
        new = edges.join(level.select("node"), "node").select(F.col("child").alias("node")).distinct().join(every, "node", "left_anti").withColumn("depth", F.lit(depth))
        level = checkpoint_table(new)
        if level.isEmpty():
            return every
        every = every.unionByName(level)
        if depth % 16 == 0:  # plans stay short
            every = checkpoint_table(every)


def missing_children(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges to nodes that aren't there."""
    return edges.join(nodes.select(F.col("node").alias("child")).distinct(), "child", "left_anti")


def scan_range(records: DataFrame, key: str, first, end, order: list[str]) -> DataFrame:
    """Records with first <= key < end in order; the filter reaches the scan."""
    return records.where((F.col(key) >= first) & (F.col(key) < end)).orderBy(*order)


def nodes_of_map(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """The nodes whose address a resolved object map names: a semi join in place of a walk over a virtual tree."""
    return nodes.join(resolved.select("image_id", "paddr").distinct(), ["image_id", "paddr"], "left_semi")
