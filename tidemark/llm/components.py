"""Connected components of an edge table by repeated contraction, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of `edges` (a long, b long): component is the smallest node reachable.

    Each round maps every node to the smallest of itself and its neighbours, then puts the edges between those
    representatives in place of the old ones. Edges shrink by a constant factor a round, so there are about
    log(nodes) rounds; each ends in a written table, which cuts the lineage. The maps compose from last to first.
    Nodes are compared as signed longs. No edges give no rows.
    """
    spark = scratch.spark
    edges = scratch.write(edges.select("a", "b").where("a <> b").distinct(), "edges-0")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        k = len(maps)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = scratch.write(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to")), f"map-{k}")
        maps.append(to)
        left = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        right = left.join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = scratch.write(right.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"edges-{k + 1}")
        scratch.drop(f"edges-{k}")
    if not maps:
        return spark.createDataFrame([], "node long, component long")
    out = maps[-1].select("node", F.col("to").alias("component"))
    for k in range(len(maps) - 2, -1, -1):
        # A representative that has no later entry is its own component.
        later = out.select(F.col("node").alias("to"), "component")
        out = scratch.write(maps[k].join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component")), f"composed-{k}")
    return out
