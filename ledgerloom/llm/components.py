"""Connected components of links, by contracting the graph level by level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import saved


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes of `links` (a, b): nodes with equal components are connected.

    At each level every node moves to the one with the smallest hash among its neighbours and itself,
    and links between the places where nodes have moved make the next, much smaller graph; the hash is another at
    each level, so chains shrink as well. Only counts reach the driver. Links of a node to itself and nulls are ignored.
    """
    edges = saved(links.select("a", "b").filter("a <> b").distinct(), "links")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        salt = F.lit(len(levels))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", salt).alias("h"), F.col("b").alias("to"))).alias("n"))
        own = F.struct(F.xxhash64("a", salt).alias("h"), F.col("a").alias("to"))
        moves = saved(nearest.select(F.col("a").alias("node"), F.least("n", own)["to"].alias("to")), "moves")
        levels.append(moves)
        edges = saved(
            edges.join(moves.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(moves.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "links")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component"))

    def onward(done: DataFrame, level: DataFrame) -> DataFrame:
        after = done.select(F.col("node").alias("to"), "component")
        return level.join(after, "to", "left").select("node", F.coalesce("component", "to").alias("component"))

    last = levels[-1].select("node", F.col("to").alias("component"))
    return reduce(onward, reversed(levels[:-1]), last)
