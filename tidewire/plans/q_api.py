"""The read API: filtered, ordered and paged lists, and documents of one story."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import api, facts
from tidewire.plans.base import query
from tidewire.session import table


@query("list_page", "SELECT doc_id, source, substr(text, 1, 200) AS title, n_chars FROM documents WHERE source = 'src3' ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 10")
def list_page(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.substring("text", 1, 200).alias("title"), "n_chars")
    return api.page(d, {"source": "src3", "lang": None}, "-n_chars", {"n_chars", "doc_id"}, "doc_id", number=2, size=20, skip=10)


@query("list_sources", "SELECT s_suppkey, s_name, s_acctbal > 0 AS enabled FROM supplier WHERE s_acctbal > 0 ORDER BY s_name LIMIT 50")
def list_sources(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", (F.col("s_acctbal") > 0).alias("enabled"))
    return api.page(s, {"enabled": True}, "s_name", {"s_name"}, "s_suppkey", size=50)


@query(
    "story_detail",
    """WITH m AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate DESC, o_orderkey) AS members, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
    SELECT c_custkey, c_name, coalesce(members, '') AS members, coalesce(n, 0) AS n, top FROM customer LEFT JOIN m ON c_custkey = o_custkey""",
)
def story_detail(spark, sf_dir):
    """One nested document for each customer: its orders, newest first."""
    doc = api.nested(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", F.struct((-F.unix_date(F.col("o_orderdate").cast("date"))).alias("d"), "o_orderkey"), "o_orderkey")
    top = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    out = doc.join(top, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", "c_name", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.size("members").cast("long").alias("n"), "top")


@query(
    "merge_stories",
    """WITH m AS (SELECT o_custkey AS story, o_orderkey AS item FROM orders) SELECT CASE WHEN story % 10 = 1 THEN story + 1 ELSE story END AS story, item FROM m""",
)
def merge_stories(spark, sf_dir):
    """Stories ending in 1 merge into the next; an item that the target has already does not move twice."""
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("story"), F.col("o_orderkey").alias("item"))
    merges = m.select("story").distinct().where("story % 10 = 1").select(F.col("story").alias("source"), (F.col("story") + 1).alias("target"))
    return api.merge(m, merges, "story", "item")


@query(
    "merge_roots",
    """WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 3 AS up FROM part WHERE p_partkey % 3 = 0 AND p_partkey > 0), r AS (SELECT node, up FROM e UNION ALL SELECT r.node, e.up FROM r JOIN e ON r.up = e.node)
    SELECT node, min(up) AS root FROM r GROUP BY node""",
)
def merge_roots(spark, sf_dir):
    """The end of each chain of merges."""
    e = table(spark, sf_dir, "part").where("p_partkey % 3 = 0 and p_partkey > 0").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 3).alias("up"))
    return api.roots(e, "node", "up")


@query(
    "fact_diff",
    """WITH f AS (SELECT conv_id, turn, substr(sha256(lower(regexp_replace(text, '[^a-zA-Z]+', '', 'g'))), 1, 16) AS h FROM conversations)
    SELECT conv_id, turn, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 'new' WHEN row_number() OVER (PARTITION BY conv_id, h ORDER BY turn) > 1 THEN 'repeated' ELSE 'new' END AS state FROM f""",
)
def fact_diff(spark, sf_dir):
    f = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(F.sha2(F.lower(F.regexp_replace("text", "[^a-zA-Z]+", "")), 256), 1, 16).alias("h"))
    return api.diff(f, "conv_id", "turn", "h").select("conv_id", "turn", "state")


@query("fact_changes")
def fact_changes(spark, sf_dir):
    """Every sentence of a conversation against those of earlier turns: new, repeated or changed. Ratios are not SQL."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"), most=1 << 30)).alias("pos", "fact"))
    return facts.diff(turns, "conv_id", "turn", "fact").select("conv_id", "turn", "pos", "state")
