"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cut


def _lowest(edges: DataFrame) -> DataFrame:
    """a, and the least of itself and its neighbours; partial aggregates keep a hub's neighbours out of one task."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node that it reaches) of every node in edges (a, b)."""
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct())
    before = None
    while True:
        two = _both_ways(e)
        large = two.join(_lowest(two), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = _lowest(large)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    return e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
