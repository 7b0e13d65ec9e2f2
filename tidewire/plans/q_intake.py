"""Intake queries: deduplication, rejection, revisions, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import numbers as N
from tidewire.functions import text as T
from tidewire.operators import intake
from tidewire.plans.base import events, query
from tidewire.session import table


@query(
    "dedupe_by_source",
    """WITH k AS (SELECT source, row_number() OVER (PARTITION BY source, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) ORDER BY doc_id) AS rn FROM documents)
    SELECT source, CAST(count(*) FILTER (WHERE rn = 1) AS BIGINT) AS created, CAST(count(*) FILTER (WHERE rn > 1) AS BIGINT) AS duplicate FROM k GROUP BY source""",
)
def dedupe_by_source(spark, sf_dir):
    """Exact copies within one source are duplicates; across sources they stay."""
    items = table(spark, sf_dir, "documents").select("doc_id", "source", T.row_hash(F.col("text")).alias("content"))
    out = intake.same_source_outcome(items, "source", ["content"], "doc_id")
    return out.groupBy("source").agg(F.count_if(F.col("outcome") == "created").alias("created"), F.count_if(F.col("outcome") != "created").alias("duplicate"))


@query(
    "intake_outcomes",
    """WITH p AS (SELECT page_id, page_id % 5 AS src, regexp_replace(url, '[?#].*$', '') AS address, sha256(regexp_replace(html, '^\\s+|\\s+$', '', 'g')) AS content FROM pages),
    a AS (SELECT *, row_number() OVER (PARTITION BY src, address ORDER BY page_id) AS n1 FROM p),
    b AS (SELECT *, CASE WHEN n1 = 1 THEN row_number() OVER (PARTITION BY src, content, n1 = 1 ORDER BY page_id) END AS n2 FROM a)
    SELECT page_id, CASE WHEN n1 > 1 THEN 'duplicate_address' WHEN n2 > 1 THEN 'duplicate_content' ELSE 'created' END AS outcome FROM b""",
)
def intake_outcomes(spark, sf_dir):
    """Several keys in order of priority: address, then content."""
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 5).alias("src"), F.regexp_replace("url", r"[?#].*$", "").alias("address"), T.row_hash(F.col("html")).alias("content"))
    return intake.same_source_outcome(p, "src", ["address", "content"], "page_id").select("page_id", "outcome")


@query(
    "reject_blank_items",
    "SELECT source, CAST(count(*) FILTER (WHERE length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) = 0) AS BIGINT) AS rejected, count(*) AS seen FROM documents GROUP BY source",
)
def reject_blank_items(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count_if(intake.blank("text")).alias("rejected"), F.count(F.lit(1)).alias("seen"))


@query(
    "revision_history",
    """WITH v AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS revision_number, previous FROM v
    WHERE n > 1 AND coalesce(text, '') <> coalesce(previous, '')""",
)
def revision_history(spark, sf_dir):
    return intake.revisions(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(
    "latest_revision",
    "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id",
)
def latest_revision(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("r")).select("conv_id", "r.*")


@query(
    "milestone_captures",
    """WITH c AS (SELECT user_id, ts, value, event_id, list_sort([[abs(age - m), m] FOR m IN [10, 30, 60, 180, 360, 720, 1440]])[1][2] AS target
      FROM (SELECT *, CAST(date_diff('second', min(ts) OVER (PARTITION BY user_id), ts) // 60 AS BIGINT) AS age FROM events))
    SELECT user_id, CAST(target AS INTEGER) AS target, arg_min(event_id, (ts, event_id)) AS event_id FROM c GROUP BY user_id, target""",
)
def milestone_captures(spark, sf_dir):
    """Each user's events as captures: the first of each nearest milestone."""
    e = events(spark, sf_dir)
    start = e.groupBy("user_id").agg(F.min("ts").alias("first"))
    age = F.floor((F.unix_seconds("ts") - F.unix_seconds("first")) / 60)
    c = e.join(start, "user_id").withColumn("target", N.nearest_milestone(age).cast("int")).withColumn("captured", F.struct("ts", "event_id"))
    return intake.milestone_once(c.select("user_id", "target", "captured", "event_id"), "user_id", "target", "captured").select("user_id", "target", "event_id")


@query(
    "next_milestones",
    """SELECT event_id, CAST(list_min(list_filter([10, 30, 60, 180, 360, 720, 1440], lambda m: m * 60 > event_id % 90000)) AS INTEGER) AS next FROM events""",
)
def next_milestones(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", N.next_milestone(F.col("event_id") % 90000).alias("next"))


@query(
    "semi_anti_sources",
    """SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
)
def semi_anti_sources(spark, sf_dir):
    """Rows that no earlier batch has: customers without orders."""
    c = table(spark, sf_dir, "customer")
    return c.join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query(
    "keyed_upsert",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def keyed_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    newer = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return intake.upsert(o, newer, ["o_orderkey"])


@query(
    "ops_snapshot",
    """SELECT CAST(ts AS DATE) AS day, count(*) AS fetches, CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS ok,
      round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 4) AS success_rate, count(DISTINCT user_id) AS sources FROM events GROUP BY 1""",
)
def ops_snapshot(spark, sf_dir):
    e = events(spark, sf_dir)
    ok = F.count_if(F.col("event_type") != "error")
    return e.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("fetches"), ok.alias("ok"), F.round(ok / F.count(F.lit(1)), 4).alias("success_rate"), F.countDistinct("user_id").alias("sources")
    )


@query(
    "job_status_counts",
    """SELECT CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS open, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS finished,
      CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS pending, count(*) AS total FROM orders""",
)
def job_status_counts(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(F.count_if(s == "O").alias("open"), F.count_if(s == "F").alias("finished"), F.count_if(s == "P").alias("pending"), F.count(F.lit(1)).alias("total"))


@query(
    "checkpoint_advance",
    "SELECT event_type, max(event_id) AS cursor, greatest(max(ts), TIMESTAMP '2024-01-15 00:00:00') AS published FROM events GROUP BY event_type",
)
def checkpoint_advance(spark, sf_dir):
    """Cursors never move back: the old one stays where it is later."""
    old = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("event_id").alias("cursor"), F.greatest(F.max("ts"), old).alias("published"))
