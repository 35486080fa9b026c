"""Connected components by concurrent breadth-first expansion.

Adjacency lists are hash-partitioned. Every node smaller than all its neighbours is a seed, so each component has at least
one. All seeds expand at once for a few rounds; where two expansions meet, their labels form an edge of a smaller graph,
which is treated the same way until nothing meets any more. Nothing is collected; a level costs two written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _level(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label) after one concurrent expansion over distinct undirected edges (u, v)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    reached = least.select(
        F.col("u").alias("node"), F.col("u").alias("label"), F.when(F.col("u") < F.col("least"), 0).otherwise(99).alias("round")
    )
    front = reached.where("round = 0").select("node", "label")
    for step in range(1, rounds + 1):
        front = (
            both.join(front, both.u == front.node)
            .groupBy(F.col("v").alias("node"))
            .agg(F.min("label").alias("label"))
        )
        reached = reached.union(front.withColumn("round", F.lit(step)))
    # the first to arrive wins; a node nobody reached keeps its own name and takes part in the next, smaller graph
    return reached.groupBy("node").agg(F.min(F.struct("round", "label")).getField("label").alias("label"))


def components(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(node, component) of every node in the undirected ``edges`` (u, v); the component's name is its least node.

    Nulls: an edge with a null end is left out. Loops and repeated edges have no effect. No edges: no rows. Further columns
    of ``edges`` are ignored.
    """
    kind = edges.schema["u"].dataType
    graph = cut(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    names: DataFrame | None = None
    while graph.take(1):
        labels = cut(_level(graph, rounds))
        lu = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        lv = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        graph = cut(
            graph.join(lu, "u").join(lv, "v").where("lu <> lv")
            .select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct()
        )
        if names is None:
            names = labels
        else:
            nxt = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
            names = names.join(nxt, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    if names is None:
        return edges.sparkSession.createDataFrame([], "node string, label string").select(
            F.col("node").cast(kind), F.col("label").cast(kind).alias("component")
        )
    least = names.groupBy("label").agg(F.min("node").alias("component"))
    return names.join(least, "label").select("node", "component")
