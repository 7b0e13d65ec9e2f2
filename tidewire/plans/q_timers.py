"""Streams with timers over the event table: each runs through what there is and ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.plans.base import query
from tidewire.session import shared_folder, table
from tidewire.streaming import timers


def _stream(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parque[t]"  # as a pattern, since a stream takes no single file
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(df: DataFrame) -> DataFrame:
    """All rows that the stream gives up to now, from a table in the shared folder."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query_ = df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck")
    query_.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


@query(
    "fast_path_triggers",
    """WITH RECURSIVE e AS (SELECT user_id AS k, epoch_us(ts) // 1000 AS t FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    g AS (SELECT k, t, CASE WHEN t - lag(t) OVER (PARTITION BY k ORDER BY t) < 10000 THEN 0 ELSE 1 END AS fresh FROM e),
    s AS (SELECT k, t, sum(fresh) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS burst FROM g),
    b AS (SELECT k, max(t) + 10000 AS due, count(*) AS signals FROM s GROUP BY k, burst),
    f AS (SELECT k, min(due) AS due FROM b GROUP BY k UNION ALL SELECT f.k, min(b.due) AS due FROM f JOIN b ON b.k = f.k AND b.due >= f.due + 300000 GROUP BY f.k, f.due)
    SELECT b.k AS user_id, CAST(b.due AS BIGINT) AS due, CAST(signals AS BIGINT) AS signals FROM f JOIN b ON b.k = f.k AND b.due = f.due WHERE b.due <= (SELECT max(t) FROM e)""",
)
def fast_path_triggers(spark, sf_dir):
    got = _drained(timers.fast_path(_stream(spark, sf_dir), "user_id", "ts", late="0 seconds"))
    return got.select("user_id", F.unix_millis("due").alias("due"), "signals")


@query("fetch_retries")
def fetch_retries(spark, sf_dir):
    """Events as fetches of a source for each user: every second is limited or fails. Jitter is not SQL."""
    outcome = F.element_at(F.array(*map(F.lit, ("ok", "failed", "failed", "limited"))), (1 + F.col("event_id") % 4).cast("int"))
    after = F.when(F.col("event_id") % 8 == 3, F.col("event_id") % 100)
    rows = _stream(spark, sf_dir).withColumn("outcome", outcome).withColumn("retry_after", after)
    got = _drained(timers.retries(rows, "user_id", "ts", "0 seconds"))
    return got.select("user_id", F.unix_millis("due").alias("due"), "attempt", "action")
