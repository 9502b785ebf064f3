"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouping by node and a join, and is written to the shared folder, so a lost
executor costs one step. The driver only compares two counters per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneltide.llm.common import discard, written


def _lowest(pairs: DataFrame) -> DataFrame:
    """u and m, the lowest of u and all v beside it in pairs (u, v).

    Stored first: a join of two plain shuffles is one that Spark may split where a node is hot.
    """
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component) for each node that has an edge; the lowest node names it."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = _lowest(both)
        large = written(both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        discard(now, lowest)
        lowest = _lowest(large)
        stars = large.join(lowest, "u")
        small = stars.select("u", F.col("m").alias("v")).unionByName(stars.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "small")
        discard(large, lowest)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
