"""Connected components over a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): nodes have one label just if links connect them.

    Each round moves every node to the first of its neighbours and itself, in an order drawn anew, and keeps the links
    between different places. At least half of the nodes are expected to go, whatever the shape, and so the rounds
    grow with the logarithm of the size. A node's neighbours are only ever aggregated.
    """
    edges = landed(_both(links), "links")
    moves, turn = [], 0
    while not edges.isEmpty():
        rank = lambda name: F.struct(F.xxhash64(name, F.lit(turn)).alias("by"), F.col(name).alias("node"))  # noqa: E731, B023
        first = edges.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a"))).alias("first"))
        move = landed(first.select(F.col("a").alias("node"), F.col("first.node").alias("to")), "moves")
        left = move.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.filter("a < b").join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = landed(_both(moved), "links")
        moves.append(move)
        turn += 1
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    found = moves[0].withColumnRenamed("to", "label")
    for move in moves[1:]:
        step = move.select(F.col("node").alias("label"), "to")
        found = found.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return found


def _both(links: DataFrame) -> DataFrame:
    links = links.select("a", "b").filter("a <> b")
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
