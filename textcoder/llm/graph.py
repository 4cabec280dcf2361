"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcoder.llm.util import cut, cut_few


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node it sees."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b); root is the smallest node reachable.

    Alternating large-star and small-star steps: every step is an aggregation and a join by node, the number
    of rounds grows with the logarithm of the longest path, and each round is checkpointed. The joins on a hub
    node can be split by AQE, since a row of either side stands for itself.
    """
    now = cut(edges.filter("a <> b").distinct())
    seen, most = None, now.count()          # no step adds links
    while True:
        now = cut_few(_small_star(_large_star(now).filter("a <> b").distinct()).filter("a <> b").distinct(), most)
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = mark
