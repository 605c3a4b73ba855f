"""Connected components over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Alternating large-star and small-star rounds; each is two shuffles over the links that are left, and is
    written to the shared folder.  Ends when the links are stars: every node hangs on one smaller node, which hangs on none.
    """
    links = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while _unsettled(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        links = materialize(small.where("u <> v").distinct())
    heads = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads.select(F.col("v").alias("node"), F.col("v").alias("component")))


def _unsettled(links: DataFrame) -> bool:
    """Whether a node hangs on two, or on one that hangs itself: one aggregation over the ends of the links."""
    end = lambda node, hangs, holds: F.struct(F.col(node).alias("node"), F.lit(hangs).alias("hangs"), F.lit(holds).alias("holds"))
    ends = links.select(F.inline(F.array(end("u", 1, 0), end("v", 0, 1))))
    seen = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not seen.where("hangs > 1 OR (hangs = 1 AND holds = 1)").isEmpty()
