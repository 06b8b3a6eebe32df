"""Connected components of an edge table by alternating large-star and small-star rounds."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges(a, b) with a <> b; either end is a neighbour of the other."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.filter("b < a")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of links(a, b): component is the smallest node reachable.

    Minima are combined before each shuffle; the join that hands them back splits a hub's rows where AQE finds
    them skewed. Each round is written to the shared folder, so lineage and lost executors cost one round.
    """
    spark = links.sparkSession
    now, path = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark
        mid, half = materialize(_star(now, True), "links-large")
        now, new = materialize(_star(mid, False), "links-small")
        discard(spark, path, half)
        path = new
    raise RuntimeError("components did not settle")
