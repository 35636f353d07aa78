"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientpulse.llm.common import Scratch


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint); the root is the smallest
    node that can be reached. A node's neighbours are never gathered: each step takes a
    minimum per node, combined before the shuffle, and joins it back. Every round is a
    stored table; the number of rounds grows with the logarithm of the longest path."""
    seen = None
    current = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("root"))
        joined = large.join(low, "a")
        small = (
            joined.where("b <> root")
            .select(F.col("b").alias("a"), F.col("root").alias("b"))
            .unionByName(low.select("a", F.col("root").alias("b")))
            .distinct()
        )
        after = scratch.keep(small)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(current)
        current = after
        if mark == seen:
            break
        seen = mark
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
