"""Registration of queries, and the views that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-01-30 00:00:00"


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


#: Stories of the event stream: their state by number, their latest update (of some unknown), items and sources.
STATES = ["active", "emerging", "merged", "archived", "stale", "rising", "breaking", "watching"]
STORIES = f"""e AS (SELECT *, event_id * 7919 % 997 AS story_id FROM events),
    stories AS (SELECT story_id, ({STATES})[1 + story_id % 8] AS status, CASE WHEN story_id % 37 = 0 THEN NULL ELSE max(ts) END AS latest, count(*) AS n, count(DISTINCT user_id) AS sources FROM e GROUP BY story_id)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("story_id", F.col("event_id") * 7919 % 997)


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = members(spark, sf_dir).groupBy("story_id").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("sources"))
    status = F.element_at(F.array(*map(F.lit, STATES)), (1 + F.col("story_id") % 8).cast("int"))
    return got.select("story_id", status.alias("status"), F.when(F.col("story_id") % 37 != 0, F.col("ts")).alias("latest"), "n", "sources")
