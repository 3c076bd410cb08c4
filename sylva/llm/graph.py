"""Connected components of an edge table: least neighbours, doubled pointers, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _rooted(trees: DataFrame) -> DataFrame:
    """trees(node, component), where component is the node's parent, once it is the root: the distance doubles in each round."""
    while True:
        up = trees.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        moved = F.col("_up").isNotNull()
        trees = written(trees.join(up.hint("merge"), "component", "left").select("node", F.coalesce("_up", "component").alias("component"), moved.alias("_moved")), "trees")
        if trees.filter("_moved").isEmpty():
            return trees.select("node", "component")
        trees = trees.select("node", "component")


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of any orderable type, which may repeat -> node, component (its smallest node), for all nodes of edges but those smallest ones.

    Every node with a smaller neighbour takes the least as its parent, pointers double until they show the roots, and
    edges between trees go on between their roots. A tree that takes in no other is taken in by the round after, so two rounds halve
    the trees, and edges that are a forest already need one. Neighbours are never gathered: each step is a
    grouped minimum, summed before the shuffle, or a join with one row a node, so hubs are split by skew handling.
    Each round is written (which of few rows costs a task for each shuffle partition, so steps of a round are few), and only counts reach the driver.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    trees = None
    while True:
        parents = written(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "parents")
        trees = _rooted(parents if trees is None else trees.unionByName(parents))
        if edges.count() == parents.count():  # each edge is one of a tree
            return trees
        root = lambda end: trees.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")).hint("merge")
        ends = edges.join(root("u"), "u").join(root("v"), "v", "left").select("_u", F.coalesce("_v", "v").alias("_v")).filter("_u <> _v")
        edges = written(ends.select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct(), "edges")
        if edges.isEmpty():
            return trees
