"""Connected components of a link table, in Spark: alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every round is written to the shared folder, so
the plan stays short and a lost executor costs one round at most. Nothing is collected but two numbers a round.
The minimum of a node's neighbours is written as a table of its own before it is joined: both sides of that join are
then plain scans, which lets adaptive execution broadcast a small side or split the partition of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vectide.llm.scratch import Scratch


def _minimum(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.keep(pairs.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "min")


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has an edge (a, b) to another; root is the component's smallest node.

    Self-links, repeated links and links in either direction are accepted; rows with a null end are ignored.
    Raises RuntimeError if `rounds` pass without a fixed point (the method needs about log2 of the longest path).
    """
    clean = edges.where("a is not null and b is not null and a <> b")
    now = scratch.keep(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _minimum(both, scratch)
        # large star: every larger neighbour of a node is tied to the smallest of the neighbourhood
        large = scratch.keep(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "large")
        scratch.drop(low)
        # small star: a node and its smaller neighbours are tied to the smallest of them
        low = _minimum(large, scratch)
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = scratch.keep(small.union(low.where("a <> low").select("a", F.col("low").alias("b"))).distinct(), "links")
        scratch.drop(now, large, low)
        now = after
    raise RuntimeError(f"no fixed point after {rounds} rounds")
