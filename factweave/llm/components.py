"""Connected components of a graph in a DataFrame, by hooking to least neighbours and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: each node of ``edges`` (long ``a``, ``b``) and the least node that it is joined with.

    In each round every node hooks to its least neighbour if that is less, the hooks are followed once more, and edges are
    drawn anew between what their ends hooked to; those within one node go. So a round costs no more than the edges that are
    still between nodes, and the least node of a component is the one that remains. Hubs are met by sums and plain joins alone.
    """
    edges = edges.select("a", "b").where("a <> b")
    edges = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    rounds: list[DataFrame] = []
    while not rounds or not edges.isEmpty():
        hooks = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")))
        further = hooks.select(F.col("a").alias("up"), F.col("up").alias("component"))
        hooked = written(hooks.join(further, "up").select(F.col("a").alias("node"), "component"))
        rounds.append(hooked)
        ends = edges.join(hooked, edges["a"] == hooked["node"]).select(F.col("component").alias("a"), "b")
        ends = ends.join(hooked, ends["b"] == hooked["node"]).select("a", F.col("component").alias("b"))
        edges = written(ends.where("a <> b").distinct())
    labels = rounds[0]
    for later in rounds[1:]:
        later = later.select(F.col("node").alias("component"), F.col("component").alias("root"))
        labels = labels.join(later, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return written(labels)
