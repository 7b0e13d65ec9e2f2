"""What is due, recent, eligible or at fault."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import selection as S
from tidewire.plans.base import AS_OF, STORIES, as_of, events, query, stories
from tidewire.session import table

_NOW = f"TIMESTAMP '{AS_OF}'"
_CLOSED = "('merged', 'archived', 'stale')"


@query("recent_stories", f"WITH {STORIES} SELECT story_id, status FROM stories WHERE latest >= {_NOW} - INTERVAL 48 HOUR AND status NOT IN {_CLOSED} ORDER BY latest DESC, story_id LIMIT 200")
def recent_stories(spark, sf_dir):
    s = stories(spark, sf_dir)
    return S.first_rows(s, S.eligible(F.col("status"), F.col("latest"), as_of()), [F.desc("latest"), F.asc("story_id")], 200).select("story_id", "status")


@query(
    "story_eligibility",
    f"""WITH {STORIES} SELECT story_id, status NOT IN {_CLOSED} AND coalesce(latest >= {_NOW} - INTERVAL 48 HOUR, false) AS eligible,
      status NOT IN {_CLOSED} AND coalesce(latest >= {_NOW} - INTERVAL 120 HOUR, false) AS eligible_extended FROM stories""",
)
def story_eligibility(spark, sf_dir):
    """The one rule that every source of candidates passes, with both look-back times."""
    own = S.eligible(F.col("status"), F.col("latest"), as_of())
    wide = S.eligible(F.col("status"), F.col("latest"), as_of(), 120)
    return stories(spark, sf_dir).select("story_id", own.alias("eligible"), wide.alias("eligible_extended"))


@query("unclustered_items", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 50")
def unclustered_items(spark, sf_dir):
    """Items without a story, oldest first."""
    e = events(spark, sf_dir).withColumn("story_id", F.when(F.col("event_type") != "error", F.col("event_id") % 97))
    return S.first_rows(e, F.col("story_id").isNull(), [F.asc("ts"), F.asc("event_id")], 50).select("event_id")


@query(
    "due_sources",
    f"""WITH u AS (SELECT user_id, user_id % 5 <> 0 AS enabled, max(ts) FILTER (WHERE event_type = 'purchase') AS last_success, max(ts) FILTER (WHERE event_type = 'error') + INTERVAL 6 HOUR AS cooldown_until, 3600 * (1 + user_id % 24) AS every FROM events GROUP BY user_id)
    SELECT user_id FROM u WHERE enabled AND NOT coalesce(cooldown_until > {_NOW}, false) AND (last_success IS NULL OR last_success + to_seconds(every) <= {_NOW})""",
)
def due_sources(spark, sf_dir):
    u = events(spark, sf_dir).groupBy("user_id").agg(
        F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_success"),
        (F.max(F.when(F.col("event_type") == "error", F.col("ts"))) + F.expr("interval 6 hours")).alias("cooldown_until"),
    )
    every = 3600 * (1 + F.col("user_id") % 24)
    return u.where(S.source_due(F.col("user_id") % 5 != 0, F.col("cooldown_until"), F.col("last_success"), every, as_of())).select("user_id")


@query("due_observations", f"WITH {STORIES} SELECT story_id FROM stories WHERE status NOT IN {_CLOSED} AND latest + to_seconds(600 * (1 + story_id % 50)) <= {_NOW} ORDER BY latest + to_seconds(600 * (1 + story_id % 50)), story_id LIMIT 50")
def due_observations(spark, sf_dir):
    s = stories(spark, sf_dir).withColumn("next_at", F.col("latest") + F.make_dt_interval(secs=(600 * (1 + F.col("story_id") % 50)).cast("decimal(18,6)")))
    keep = S.due(~F.col("status").isin(*S.CLOSED), F.col("next_at"), as_of())
    return S.first_rows(s, keep, [F.asc("next_at"), F.asc("story_id")], 50).select("story_id")


@query("due_engagement", f"SELECT event_id FROM events WHERE event_type <> 'signup' AND ts + to_seconds(600 * (1 + event_id % 200)) <= {_NOW} ORDER BY ts + to_seconds(600 * (1 + event_id % 200)), event_id LIMIT 200")
def due_engagement(spark, sf_dir):
    """Items whose counters are to be read again; signups are not followed."""
    e = events(spark, sf_dir).withColumn("next_at", F.col("ts") + F.make_dt_interval(secs=(600 * (1 + F.col("event_id") % 200)).cast("decimal(18,6)")))
    return S.first_rows(e, S.due(F.col("event_type") != "signup", F.col("next_at"), as_of()), [F.asc("next_at"), F.asc("event_id")], 200).select("event_id")


@query("ranking_candidates", f"WITH {STORIES} SELECT story_id FROM stories WHERE status IN ('active', 'emerging') AND latest >= {_NOW} - INTERVAL 48 HOUR ORDER BY latest DESC, story_id LIMIT 50")
def ranking_candidates(spark, sf_dir):
    keep = F.col("status").isin("active", "emerging") & S.recent(F.col("latest"), as_of())
    return S.first_rows(stories(spark, sf_dir), keep, [F.desc("latest"), F.asc("story_id")], 50).select("story_id")


@query("ranking_refresh", f"WITH {STORIES} SELECT story_id FROM stories WHERE status <> 'merged' AND latest >= {_NOW} - INTERVAL 48 HOUR ORDER BY story_id LIMIT 100")
def ranking_refresh(spark, sf_dir):
    keep = (F.col("status") != "merged") & S.recent(F.col("latest"), as_of())
    return S.first_rows(stories(spark, sf_dir), keep, [F.asc("story_id")], 100).select("story_id")


@query("backtest_set", f"WITH {STORIES} SELECT story_id FROM stories WHERE status <> 'merged' AND latest BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-28' ORDER BY latest DESC, story_id LIMIT 100")
def backtest_set(spark, sf_dir):
    span = F.col("latest").between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-28").cast("timestamp"))
    return S.first_rows(stories(spark, sf_dir), (F.col("status") != "merged") & span, [F.desc("latest"), F.asc("story_id")], 100).select("story_id")


@query(
    "topic_lookup",
    """SELECT s_suppkey, r_regionkey AS topic, n_nationkey AS subtopic FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN 'none' ELSE lower(n_name) END AS slug, lower(r_name) AS topic_slug FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) x
    LEFT JOIN region ON lower(r_name) = topic_slug AND r_regionkey <> 3 LEFT JOIN nation ON lower(n_name) = slug AND n_regionkey = r_regionkey""",
)
def topic_lookup(spark, sf_dir):
    """Slugs to topics, of which one is switched off, and within them to subtopics; unknown slugs give null. The dimensions
    have a fixed size and are broadcast."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    raw = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = raw.select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, "none").otherwise(F.lower("n_name")).alias("slug"), F.lower("r_name").alias("topic_slug"))
    topics = region.where("r_regionkey <> 3").select(F.lower("r_name").alias("topic_slug"), F.col("r_regionkey").alias("topic"))
    subs = nation.select(F.col("n_regionkey").alias("topic"), F.lower("n_name").alias("slug"), F.col("n_nationkey").alias("subtopic"))
    return raw.join(F.broadcast(topics), "topic_slug", "left").join(F.broadcast(subs), ["topic", "slug"], "left").select("s_suppkey", "topic", "subtopic")


@query("topic_slugs", "SELECT lower(n_name) AS slug FROM nation WHERE n_regionkey <> 3 ORDER BY slug LIMIT 100")
def topic_slugs(spark, sf_dir):
    return S.first_rows(table(spark, sf_dir, "nation").select(F.lower("n_name").alias("slug"), "n_regionkey"), F.col("n_regionkey") != 3, [F.asc("slug")], 100).select("slug")


@query(
    "member_vector_states",
    """SELECT vec_id, CASE WHEN vec_id % 5 = 0 OR vec_id % 11 = 0 OR len(embedding) <> 64 THEN 'skipped' WHEN vec_id % 13 = 0 THEN 'stale' ELSE 'valid' END AS state FROM embeddings""",
)
def member_vector_states(spark, sf_dir):
    """Vectors that may stand for a member: indexed, of the same model and size, and of the text as it is now."""
    v = F.col("vec_id")
    live = F.sha2(v.cast("string"), 256)
    state = S.vector_state(F.when(v % 5 == 0, "pending").otherwise("indexed"), v % 11 != 0, F.size("embedding"), 64, F.when(v % 13 == 0, F.lit("old")).otherwise(live), live)
    return table(spark, sf_dir, "embeddings").select("vec_id", state.alias("state"))


@query(
    "breakdown_faults",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END + CASE WHEN l_linenumber % 5 > 0 AND l_discount * 25 - 0.5 NOT BETWEEN 0 AND 1 THEN 1 ELSE 0 END AS INTEGER) AS faults FROM lineitem""",
)
def breakdown_faults(spark, sf_dir):
    """Score breakdowns: groups of numbers, of which some lack a group or go beyond 0 to 1."""
    one = lambda x: F.create_map(F.lit("x"), x)
    groups = F.create_map(F.lit("news_value"), one(F.col("l_quantity") / 40), F.lit("audience_fit"), one(F.col("l_tax")), F.lit("momentum"), one(F.col("l_discount") * 25 - 0.5))
    given = F.when(F.col("l_linenumber") % 5 == 0, F.map_filter(groups, lambda k, _: k != "momentum")).otherwise(groups)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.breakdown_faults(given).alias("faults"))


@query(
    "constraint_violations",
    """SELECT rule, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS violations FROM (SELECT l_discount NOT BETWEEN 0 AND 1 AS a, l_quantity < 0 AS b, l_tax NOT BETWEEN 0 AND 0.05 AS c FROM lineitem) UNPIVOT (bad FOR rule IN (a, b, c)) GROUP BY rule""",
)
def constraint_violations(spark, sf_dir):
    """Rows that break each domain rule, in one pass."""
    rules = {"a": ~F.col("l_discount").between(0, 1), "b": F.col("l_quantity") < 0, "c": ~F.col("l_tax").between(0, 0.05)}
    counts = table(spark, sf_dir, "lineitem").agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


@query("search_items", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'de') AND (contains(lower(text), 'license') OR contains(lower(source), 'license'))")
def search_items(spark, sf_dir):
    return S.search(table(spark, sf_dir, "documents"), "LICENSE", ["text", "source"], source=["src1", "src2", "src3"], lang=["en", "de"]).select("doc_id", "source")
