"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, label) for every node of `edges` (src, dst: bigint, not null); label: the smallest node it can reach.

    Each round is two aggregations and two joins over the edges that are left and ends in a checkpoint, so lineage
    stays short. Edges shrink towards stars; rounds grow with the logarithm of the longest path. Loops and repeated
    edges do no harm; no edges give an empty result.
    """
    now = cut(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).filter("a != b").distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = cut(small.distinct())
        was, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
