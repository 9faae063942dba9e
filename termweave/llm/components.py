"""Connected components by alternating large-star and small-star rounds on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import stage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b): returns (node, component), component being the smallest node that is connected.

    Nodes without an edge don't appear. Each round is two aggregations by node with map-side combine and two
    joins whose hot side Spark can split, so that a hub with many neighbours needs no large task. Rounds are
    written to the shared folder. Empty edges give an empty table. Nulls in a or b are ignored.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    e = stage(e.distinct(), "cc")
    nodes = None
    for k in range(rounds):
        # large star: of each node, link its larger neighbours to its smallest one
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u <> v").distinct()
        # small star: of each node, link its smaller neighbours and itself to the smallest of them
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        # the graph is a set of stars when no edge's end is itself a larger end
        if new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            heads = new.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            if heads.where("n > 1").isEmpty():
                nodes = new
                break
        e = new
    if nodes is None:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        nodes.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
