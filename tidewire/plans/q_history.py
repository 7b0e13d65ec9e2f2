"""The event table as a chat's history that is fetched with a cursor, and as events of runs in an audit log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewire.plans.base import events, query
from tidewire.session import shared_folder, table
from tidewire.sources import audit
from tidewire.sources.history import History


@query(
    "message_history",
    """WITH m AS (SELECT max(event_id) // 2 AS half FROM events), l AS (SELECT max(event_id) AS seen FROM events, m WHERE event_id <= half)
    SELECT event_id, user_id, event_type, CAST(CASE WHEN event_id <= seen AND event_id > seen - 25 THEN 2 ELSE 1 END AS BIGINT) AS times FROM events, l WHERE event_id IS NOT NULL""",
)
def message_history(spark, sf_dir):
    """All events, fetched in two runs of one stream: as the history stood at half, and then what came after it and the
    look-back. `times` is how often a message was fetched."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    folder = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    e.write.parquet(f"{folder}/export")
    spark.dataSource.register(History)
    half = e.agg(F.max("event_id")).first()[0]
    for until in ([half // 2] if half is not None else []) + [None]:
        source = spark.readStream.format("history").schema("event_id long, user_id long, event_type string, again boolean").option("path", f"{folder}/export").option("key", "event_id")
        source = source if until is None else source.option("until", until)
        run = source.load().writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck")
        run.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("event_id long, user_id long, event_type string, again boolean").parquet(f"{folder}/out")
    return got.groupBy("event_id", "user_id", "event_type").agg(F.count(F.lit(1)).alias("times"))


@query(
    "audit_runs",
    """SELECT CASE WHEN event_type = 'error' THEN 'errors' ELSE 'others' END AS run, 'success' AS status, CAST(count(*) AS DOUBLE) AS rows, CAST(count(user_id) AS DOUBLE) AS known, CAST(max(event_id) AS DOUBLE) AS last,
    count(*) AS recorded, count(*) AS masked, sum(event_id) AS ids FROM events GROUP BY ALL""",
)
def audit_runs(spark, sf_dir):
    """Two runs' events in an audit log, one of them recorded twice: the counters that were observed, and what the log holds."""
    e = events(spark, sf_dir)
    path = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    counters = {"rows": F.count(F.lit(1)), "known": F.count("user_id"), "last": F.max("event_id")}
    is_error = F.coalesce(F.col("event_type") == "error", F.lit(False))
    told = F.concat_ws(" ", F.lit("api_key=k-12345678"), F.col("event_type"), F.col("props"))
    for run, some in (("errors", is_error), ("others", ~is_error), ("errors", is_error)):
        rows = audit.events_of(e.where(some), F.col("event_type"), F.col("ts"), told, {"user_id": F.col("user_id"), "event_id": F.col("event_id")})
        audit.record(rows, path, run, counters)
    log = audit.recorded(spark, f"{path}/events", "event string, at timestamp, message string, user_id long, event_id long")
    sums = log.groupBy("run").agg(F.count(F.lit(1)).alias("recorded"), F.count_if(F.contains("message", F.lit("[REDACTED]")) & ~F.contains("message", F.lit("k-12345678"))).alias("masked"), F.sum("event_id").alias("ids"))
    return audit.runs(spark, path, list(counters)).join(sums, "run").select("run", "status", *counters, "recorded", "masked", "ids")
