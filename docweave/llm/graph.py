"""Connected components in Spark by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import discard, stored


def _digest(edges: DataFrame) -> tuple:
    """Number of links and sum of their hashes: equal for equal sets of links."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component): the least node reachable from each node that has a link.

    ``links`` has columns a and b of one orderable type.  Every step is joins and minima over links, so a node with very
    many links is no more than a skewed key; steps are stored in the shared folder until nothing changes.  More than ``limit`` steps, which
    only chains of some 2 ** limit links would need, raise an error.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _digest(edges)
    for _ in range(limit):
        # large star: every larger neighbour of a node goes to the least of node and neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")
        # small star: a node and its smaller neighbours go to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = stored(small.where("u <> v").distinct(), "small-star")
        discard(large)
        if (now := _digest(new)) == before:
            break
        discard(edges)
        edges, before = new, now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
