"""Connected components by alternating large-star and small-star rounds (Kiveris et al.), on DataFrames only.

Each round is two grouped minima and two joins over the edges; it is written to a table, and the loop ends when a round changes
nothing. Rounds grow with the logarithm of the longest path. Nodes with more than an even share of the edges (the centre of a
large component) are joined by broadcast, so no task gets all edges of one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, partitions

#: Rows of one key that any task takes.
LEAST_HOT = 64


def spread_join(rows: DataFrame, by_key: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` (about ``size`` of them) with what ``by_key``, one row a key with its number of rows ``n``, says of their key.

    Keys with more rows than a partition has on average are broadcast: as many as there are partitions at most.
    """
    most = max(LEAST_HOT, -(-size // partitions(rows.sparkSession)))
    hot = by_key.where(F.col("n") > most).drop("n")
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(by_key.where(F.col("n") <= most).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """``edges`` (a, b) to one row per node that is not its component's smallest: (node, root)."""
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.table(both, f"{name}-0")
    seen, turn = None, 0
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, turn = mark, turn + 1
        large = scratch.table(_large_star(now, mark[0]), f"{name}-large")
        now = scratch.table(_small_star(large, mark[0]), f"{name}-{turn}")


def _large_star(edges: DataFrame, size: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node's neighbourhood."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return spread_join(around.where("b > a"), least, "a", 2 * size).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, size: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Edges point from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    tied = spread_join(edges, least, "a", size).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def classed(scratch: Scratch, nodes: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """``nodes`` (nid, first, ...) with their class's smallest ``first`` as ``head``, however many of them one class has."""
    own = nodes.join(classes.select(F.col("node").alias("nid"), "root"), "nid", "left").withColumn("class", F.coalesce("root", "nid")).drop("root")
    own = scratch.table(own, name)
    heads = own.groupBy("class").agg(F.min("first").alias("head"), F.count("*").alias("n"))
    return spread_join(own, heads, "class", own.count()).drop("class")
