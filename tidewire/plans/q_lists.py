"""Lists of the read API, and its small edits. Every list is a bounded page by nature."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import api, ranking
from tidewire.operators import stories as ST
from tidewire.operators.publishing import canonical_hash, may_follow, post_key
from tidewire.plans.base import STORIES, events, members, query, stories
from tidewire.session import table

_T = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


def _second(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("health", "SELECT 'ok' AS status, '1' AS version")
def health(spark, sf_dir):
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit("1").alias("version"))


@query("list_stories", f"WITH {STORIES} SELECT story_id, status, n FROM stories WHERE status = 'active' ORDER BY n DESC, story_id LIMIT 50")
def list_stories(spark, sf_dir):
    return api.page(stories(spark, sf_dir).select("story_id", "status", "n"), {"status": "active"}, "-n", {"n", "latest"}, "story_id", cap=50)


@query("list_selection_runs", f"WITH r AS (SELECT date_trunc('day', ts) AS d, count(*) AS candidates, count(*) FILTER (WHERE value > 50) AS selected FROM events GROUP BY 1) SELECT strftime(d, '%Y-%m-%d') AS run_at, candidates, selected FROM r ORDER BY d DESC LIMIT 20")
def list_selection_runs(spark, sf_dir):
    """Runs with the length of their candidate lists, newest first; the lists themselves are not gathered."""
    r = events(spark, sf_dir).groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("value") > 50).alias("selected"))
    return api.page(r, {}, "-d", {"d"}, "d", size=20, cap=100).select(F.date_format("d", "yyyy-MM-dd").alias("run_at"), "candidates", "selected")


@query("list_members", "SELECT event_id, user_id, event_id % 3 = 0 AS is_primary FROM events WHERE event_id * 7919 % 997 = 5 AND event_type <> 'error' ORDER BY event_id LIMIT 50")
def list_members(spark, sf_dir):
    m = members(spark, sf_dir).select("event_id", "user_id", (F.col("event_id") % 3 == 0).alias("is_primary"), "story_id", (F.col("event_type") != "error").alias("is_current"))
    return api.page(m, {"story_id": 5, "is_current": True}, "", set(), "event_id").select("event_id", "user_id", "is_primary")


@query("list_decisions", f"SELECT event_id, event_type AS decision, {_T} AS created FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id LIMIT 50")
def list_decisions(spark, sf_dir):
    d = events(spark, sf_dir).select("event_id", "user_id", F.col("event_type").alias("decision"), "ts")
    return api.page(d, {"user_id": 8}, "-ts", {"ts"}, "event_id").select("event_id", "decision", _second("ts").alias("created"))


@query("list_scores", f"SELECT event_id, round(value / 500, 4) AS final_score, {_T} AS created FROM events WHERE event_id * 7919 % 997 = 7 ORDER BY ts DESC, event_id LIMIT 50")
def list_scores(spark, sf_dir):
    d = members(spark, sf_dir).select("event_id", "story_id", F.round(F.col("value") / 500, 4).alias("final_score"), "ts")
    return api.page(d, {"story_id": 7}, "-ts", {"ts"}, "event_id", cap=50).select("event_id", "final_score", _second("ts").alias("created"))


@query("list_publications", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey DESC LIMIT 50 OFFSET 50")
def list_publications(spark, sf_dir):
    """Second page; an ordering that is not allowed falls back to the default, newest first."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return api.page(o.withColumn("newest", -F.col("o_orderkey")), {"o_orderstatus": "P"}, "secret", {"o_orderdate"}, "newest", number=2).select("o_orderkey", "o_orderstatus")


@query("list_fetch_runs", f"SELECT event_id, event_type AS outcome, {_T} AS started FROM events WHERE user_id = 3 ORDER BY ts DESC, event_id LIMIT 50")
def list_fetch_runs(spark, sf_dir):
    r = events(spark, sf_dir).select("event_id", F.col("event_type").alias("outcome"), "user_id", "ts")
    return api.page(r, {"user_id": 3}, "-ts", {"ts"}, "event_id").select("event_id", "outcome", _second("ts").alias("started"))


@query("list_topics", "SELECT n_nationkey, lower(n_name) AS slug FROM nation ORDER BY slug LIMIT 50")
def list_topics(spark, sf_dir):
    return api.page(table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("slug")), {}, "slug", {"slug"}, "n_nationkey")


@query("list_settings", "SELECT DISTINCT p_brand AS key, 'Brand ' || p_brand AS description FROM part ORDER BY key LIMIT 50")
def list_settings(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key")).distinct().withColumn("description", F.concat(F.lit("Brand "), "key"))
    return api.page(s, {}, "key", {"key"}, "key")


@query("list_flags", "SELECT p_type AS key, count(*) % 2 = 0 AS enabled FROM part GROUP BY p_type ORDER BY key LIMIT 50")
def list_flags(spark, sf_dir):
    f = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("key")).agg((F.count(F.lit(1)) % 2 == 0).alias("enabled"))
    return api.page(f, {}, "key", {"key"}, "key", cap=100)


@query(
    "rescore_story",
    """WITH m AS (SELECT count(*) AS n, count(DISTINCT user_id) AS s FROM events WHERE event_id * 7919 % 997 = 12)
    SELECT 12 AS story_id, round(0.45 * round((least(1.0, 0.4 + 0.15 * least(4, n)) + 0.5 + 0.5 + 0.7 + 0.5 + least(1.0, 0.4 + 0.2 * least(3, s))) / 6, 4) + 0.30 * 0.5 + 0.20 * 0.5 + 0.05 * 0.5, 4) AS final_score, 'story.rescore' AS action FROM m WHERE n > 0""",
)
def rescore_story(spark, sf_dir):
    """The score of one story again, with the audit entry of the request. Without analysis the fallback values hold."""
    m = members(spark, sf_dir).where("story_id = 12").groupBy("story_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("s"))
    half = F.lit(0.5)
    known = [F.least(F.lit(1.0), 0.4 + 0.15 * F.least(F.lit(4), "n")), half, half, F.lit(0.7), half, F.least(F.lit(1.0), 0.4 + 0.2 * F.least(F.lit(3), "s"))]
    final = F.round(ranking.final_score(ST.news_value(known), half, half, half).cast("double"), 4)
    return m.select(F.col("story_id").cast("int").alias("story_id"), final.alias("final_score"), F.lit("story.rescore").alias("action"))


@query("recluster_story", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'queued' ELSE 'already_clustered' END AS outcome FROM events WHERE event_id * 7919 % 997 = 3")
def recluster_story(spark, sf_dir):
    """Every member is queued again; one that has a story stays where it is."""
    m = members(spark, sf_dir).where("story_id = 3").withColumn("story", F.when(F.col("event_type") != "error", F.col("story_id")))
    return m.select("event_id", F.when(F.col("story").isNull(), "queued").otherwise("already_clustered").alias("outcome"))


@query(
    "reassign_items",
    """WITH m AS (SELECT event_id AS item, event_id * 7919 % 997 AS story FROM events)
    SELECT item, story, item % 50 <> 0 OR story = item % 31 AS is_current FROM m UNION ALL SELECT item, item % 31 AS story, true FROM m WHERE item % 50 = 0 AND story <> item % 31""",
)
def reassign_items(spark, sf_dir):
    """Every fiftieth item moves to another story; its old membership stays as history."""
    m = members(spark, sf_dir).select(F.col("event_id").alias("item"), F.col("story_id").alias("story"), F.lit(True).alias("is_current"))
    moves = m.where("item % 50 = 0").select("item", (F.col("item") % 31).alias("target"))
    return ST.reassign(m, moves, "item", "story", "is_current")


@query(
    "review_publications",
    """WITH o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'ready' WHEN 'O' THEN 'published' ELSE 'draft' END AS now, CASE WHEN o_orderkey % 2 = 0 THEN 'approved' ELSE 'cancelled' END AS wanted FROM orders),
    a AS (SELECT *, now = 'ready' OR (now = 'draft' AND wanted = 'cancelled') AS allowed FROM o) SELECT o_orderkey, wanted, allowed, CASE WHEN allowed THEN wanted ELSE now END AS state FROM a""",
)
def review_publications(spark, sf_dir):
    """Approvals and rejections: a change that may not follow leaves the state as it is."""
    now = F.when(F.col("o_orderstatus") == "P", "ready").when(F.col("o_orderstatus") == "O", "published").otherwise("draft")
    o = table(spark, sf_dir, "orders").select("o_orderkey", now.alias("now"), F.when(F.col("o_orderkey") % 2 == 0, "approved").otherwise("cancelled").alias("wanted"))
    o = o.withColumn("allowed", may_follow(F.col("now"), F.col("wanted")))
    return o.select("o_orderkey", "wanted", "allowed", F.when(F.col("allowed"), F.col("wanted")).otherwise(F.col("now")).alias("state"))


@query(
    "publication_states",
    """WITH s(state, n) AS (VALUES ('draft', 0), ('ready', 1), ('approved', 2), ('scheduled', 3), ('publishing', 4), ('failed', 5), ('published', 6), ('cancelled', 7)),
    ok(a, b) AS (VALUES ('draft', 'ready'), ('draft', 'cancelled'), ('ready', 'approved'), ('ready', 'cancelled'), ('approved', 'scheduled'), ('approved', 'publishing'), ('approved', 'cancelled'), ('scheduled', 'publishing'),
      ('scheduled', 'cancelled'), ('scheduled', 'failed'), ('publishing', 'published'), ('publishing', 'failed'), ('failed', 'publishing'), ('failed', 'scheduled'), ('failed', 'cancelled'))
    SELECT event_id, CASE WHEN ok.a IS NULL THEN 'refused' ELSE 'done' END AS outcome FROM events JOIN s x ON x.n = event_id % 8 JOIN s y ON y.n = event_id // 8 % 8 LEFT JOIN ok ON ok.a = x.state AND ok.b = y.state""",
)
def publication_states(spark, sf_dir):
    """Every pair of states, as changes asked for."""
    states = F.array(*map(F.lit, ["draft", "ready", "approved", "scheduled", "publishing", "failed", "published", "cancelled"]))
    at = lambda n: F.element_at(states, (n % 8 + 1).cast("int"))
    ok = may_follow(at(F.col("event_id")), at(F.floor(F.col("event_id") / 8)))
    return events(spark, sf_dir).select("event_id", F.when(ok, "done").otherwise("refused").alias("outcome"))


@query(
    "dry_run_posts",
    """SELECT conv_id, turn, 'story-' || conv_id || CASE WHEN turn > 0 THEN '-v' || (turn + 1) ELSE '' END || '-' || substr(sha256('{"headline":' || to_json(role) || ',"turn":' || turn || '}'), 1, 16) AS key FROM conversations""",
)
def dry_run_posts(spark, sf_dir):
    """The key that a post would get; nothing is sent."""
    digest = canonical_hash(turn=F.col("turn"), headline=F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", post_key(F.col("conv_id"), F.col("turn") + 1, digest).alias("key"))
