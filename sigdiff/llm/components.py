"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step groups links by a node and moves them to the least neighbour; links only ever shrink to stars. A step is
written to the shared folder, so that lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigdiff.llm.common import stored


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("low"))
    moved = links.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Gives node and component (the least node it reaches) of every node that is not itself the least."""
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if now.isEmpty():
        return ends
    while True:
        now = stored(_small(_large(now)), "stars")
        # every link goes to a lesser node, so once no link's lesser end has a link of its own, all of them end at the least nodes
        if now.join(now.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
