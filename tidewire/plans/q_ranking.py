"""Ranking, editorial, publishing and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.functions import fuzzy
from tidewire.functions import numbers as N
from tidewire.operators import momentum as MO
from tidewire.operators import publishing as P
from tidewire.operators import ranking as R
from tidewire.plans.base import events, query
from tidewire.session import table

_CL = "round(round(greatest(0, least(1, {0})), 9), 4)"
_CL6 = _CL.replace(", 4)", ", 7)")  # no ties there
_K = {"i": (7, 6), "u": (11, 10), "c": (13, 12), "m": (17, 16), "p": (5, 4)}


def _sig(name):
    """A signal in 0..1 made from the document id."""
    a, b = _K[name]
    return (F.col("doc_id") % a) / b


def _sql(name):
    a, b = _K[name]
    return f"((doc_id % {a}) / {b}.0)"


_NEWS = _CL.format(f"0.25 * least(1, 0.4 + 0.15 * least(4, doc_id % 6)) + 0.2 * {_sql('i')} + 0.15 * 0.5 + 0.15 * 0.7 + 0.1 * {_sql('u')} + 0.15 * least(1, 0.4 + 0.2 * least(3, doc_id % 4))")


def _news():
    k = F.col("doc_id")
    return R.newsworthiness(k % 6, k % 4, impact=_sig("i"), urgency=_sig("u"))


@query("newsworthiness", f"SELECT doc_id, {_NEWS} AS news FROM documents")
def newsworthiness(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _news().alias("news"))


_AUD = _CL.format(f"0.4 * coalesce(least(1, quality * {_sql('m')} / 2), 0.5) + 0.3 * {_sql('p')} + 0.15 * 0.6 + 0.15 * CASE WHEN lang IN ('fa', 'en') THEN 1.0 ELSE 0.5 END")


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("audience_fit", f"SELECT doc_id, {_AUD} AS audience FROM documents LEFT JOIN labels USING (doc_id)")
def audience_fit(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", R.audience_fit(F.col("quality") * _sig("m"), _sig("p"), F.col("lang")).alias("audience"))


@query("final_score", f"WITH s AS (SELECT doc_id, {_NEWS} AS n, {_AUD} AS a FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, {_CL6.format('0.45 * n + 0.3 * ' + _sql('m') + ' + 0.2 * a + 0.05 * ' + _sql('c'))} AS score FROM s")
def final_score(spark, sf_dir):
    s = _labelled(spark, sf_dir).withColumn("n", _news()).withColumn("a", R.audience_fit(F.col("quality") * _sig("m"), _sig("p"), F.col("lang")))
    return s.select("doc_id", R.final_score(F.col("n"), _sig("m"), F.col("a"), _sig("c"), 7).alias("score"))


_CRED = _CL.format(f"0.45 * {_sql('c')} + 0.25 * least(1, (doc_id % 4) / 3) + 0.3 * coalesce(CAST(quality AS DOUBLE), 0.5) - 0.25 * coalesce(CAST(toxic AS DOUBLE), 0)")


@query(
    "credibility_gate",
    f"""WITH s AS (SELECT doc_id, {_CRED} AS cred, toxic, doc_id % 4 AS indep, {_sql('c')} AS trust FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, cred, CASE WHEN cred < 0.25 THEN 'low_credibility' WHEN coalesce(toxic, 0) >= 0.6 THEN 'high_conflict' WHEN indep <= 1 AND trust < 0.3 THEN 'single_weak_source' ELSE 'pass' END AS gate FROM s""",
)
def credibility_gate(spark, sf_dir):
    indep = F.col("doc_id") % 4
    s = _labelled(spark, sf_dir).withColumn("cred", R.credibility(_sig("c"), indep, F.col("quality").cast("double"), F.col("toxic").cast("double")))
    return s.select("doc_id", "cred", R.gate(F.col("cred"), F.col("toxic"), indep, _sig("c")).alias("gate"))


_SAT = """sat AS (SELECT o_orderkey, o_orderpriority, o_orderdate, o_totalprice, o_orderstatus, count(*) FILTER (WHERE o_orderstatus <> 'P') OVER (PARTITION BY o_orderpriority, o_orderdate) - CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS recent FROM orders)"""


def _saturated(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    # Days as the unit of time: one window for each topic and day, so that no topic is gathered in one task.
    o = o.withColumn("topic", F.concat_ws("|", "o_orderpriority", F.date_format("at", "yyyy-MM-dd")))
    return R.topic_saturation(o, "topic", "at", F.col("o_orderstatus") != "P")


@query("topic_saturation", f"WITH {_SAT} SELECT o_orderkey, CAST(recent AS BIGINT) AS recent, CASE WHEN recent >= 2 THEN CAST(round(least(0.3, 0.1 * (recent - 1)), 2) AS DOUBLE) ELSE 0 END AS penalty FROM sat")
def topic_saturation(spark, sf_dir):
    return _saturated(spark, sf_dir).select("o_orderkey", "recent", F.col("penalty"))


_PRIO = _CL6.format("0.35 * n + 0.2 * m + 0.1 * a + 0.15 * u + 0.05 * f + 0.1 * (1 - exp(-0.7 * i)) + 0.05 * CASE nov WHEN 'NEW' THEN 1.0 WHEN 'MATERIAL' THEN 0.9 WHEN 'CORRECTION' THEN 0.9 ELSE 0.1 END + CASE WHEN nov = 'CORRECTION' THEN 0.1 ELSE 0 END - pen - greatest(0, 0.4 - c)")
_CAND = f"""{_SAT}, cand AS (SELECT o_orderkey, (o_orderkey % 97) / 96.0 AS n, (o_orderkey % 89) / 88.0 AS m, (o_orderkey % 7) / 6.0 AS a, (o_orderkey % 5) / 4.0 AS u, (o_orderkey % 11) / 10.0 AS f, o_orderkey % 4 AS i, (o_orderkey % 13) / 12.0 AS c,
  CASE WHEN o_orderstatus = 'O' THEN 'NEW' WHEN o_orderkey % 5 = 0 THEN 'REPEAT' WHEN o_orderkey % 5 = 1 THEN 'CORRECTION' WHEN o_orderkey % 5 = 2 THEN 'MATERIAL' WHEN o_orderkey % 5 = 3 THEN 'MINOR' ELSE 'REPEAT' END AS nov,
  CASE WHEN recent >= 2 THEN round(least(0.3, 0.1 * (recent - 1)), 2) ELSE 0 END AS pen FROM sat),
  prio AS (SELECT *, {_PRIO} AS priority FROM cand)"""


def _candidates(spark, sf_dir):
    k = F.col("o_orderkey")
    label = F.when(k % 5 == 1, "CORRECTION").when(k % 5 == 2, "MATERIAL_UPDATE").when(k % 5 == 3, "MINOR_UPDATE").when(k % 5 == 4, "OTHER")
    s = _saturated(spark, sf_dir).withColumns({"n": (k % 97) / 96, "m": (k % 89) / 88, "a": (k % 7) / 6, "u": (k % 5) / 4, "f": (k % 11) / 10, "i": k % 4, "c": (k % 13) / 12})
    s = s.withColumn("nov", R.novelty(F.col("o_orderstatus") != "O", label, F.lit(0)))
    c = F.col
    return s.withColumn("priority", R.priority(c("n"), c("m"), c("a"), c("u"), c("f"), c("i"), c("nov"), c("penalty"), F.lit(0.0), c("c"), 7))


@query("publish_priority", f"WITH {_CAND} SELECT o_orderkey, nov AS novelty, priority FROM prio")
def publish_priority(spark, sf_dir):
    return _candidates(spark, sf_dir).select("o_orderkey", F.col("nov").alias("novelty"), "priority")


_ACT = """act AS (SELECT *, CASE WHEN c < 0.25 THEN 'REJECT' WHEN nov IN ('REPEAT', 'MINOR') THEN 'SKIP' WHEN nov IN ('MATERIAL', 'CORRECTION') THEN CASE WHEN priority >= 0.52 THEN CASE WHEN m >= 0.9 THEN 'PUBLISH_NOW' ELSE 'UPDATE_EXISTING_STORY' END ELSE 'SKIP' END
  WHEN (i < 2 AND n >= 0.7) OR (a >= 0.7 AND priority < 0.68) OR (priority >= 0.5 AND priority < 0.68 AND i <= 1) THEN 'WATCH' WHEN (m >= 0.9 AND priority >= 0.58) OR priority >= 0.68 THEN 'PUBLISH_NOW' WHEN priority >= 0.52 THEN 'SCHEDULE' ELSE 'SKIP' END AS action FROM prio)"""


def _actions(spark, sf_dir):
    c = F.col
    g = F.when(c("c") < 0.25, "low_credibility").otherwise("pass")
    return _candidates(spark, sf_dir).withColumn("action", R.editorial(g, c("nov"), c("priority"), c("m") >= 0.9, c("i"), c("n"), c("a")))


@query("editorial_action", f"WITH {_CAND}, {_ACT} SELECT o_orderkey, action, CASE WHEN action IN ('PUBLISH_NOW', 'UPDATE_EXISTING_STORY', 'SCHEDULE') THEN 'publish' WHEN action IN ('WATCH', 'REJECT') THEN 'hold' ELSE 'skip' END AS legacy FROM act")
def editorial_action(spark, sf_dir):
    return _actions(spark, sf_dir).select("o_orderkey", "action", R.legacy_action(F.col("action")).alias("legacy"))


@query("backtest_report", f"WITH {_CAND}, {_ACT} SELECT action, count(*) AS n, round(avg(priority), 4) AS mean, max(priority) AS most, min(priority) AS least FROM act GROUP BY action")
def backtest_report(spark, sf_dir):
    p = F.col("priority")
    return _actions(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 4).alias("mean"), F.max(p).alias("most"), F.min(p).alias("least"))


@query("selection_topk", f"WITH {_CAND}, {_ACT} SELECT o_orderkey, priority FROM act WHERE action = 'PUBLISH_NOW' ORDER BY priority DESC, o_orderkey LIMIT 25")
def selection_topk(spark, sf_dir):
    """The selection batch: a top-k report by nature."""
    return _actions(spark, sf_dir).where("action = 'PUBLISH_NOW'").orderBy(F.desc("priority"), "o_orderkey").limit(25).select("o_orderkey", "priority")


@query("repetition_penalty")
def repetition_penalty(spark, sf_dir):
    """Headlines against the last 30 of their brand in 12 hours, by sorted-token ratio; Python in Arrow batches."""
    at = F.timestamp_micros(F.col("p_partkey").cast("long") * 20_000_000)
    p = P.recent_of(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", at.alias("at")), "p_brand", "at", "p_name")
    pairs = p.select("p_partkey", "p_name", F.explode("recent").alias("old"))
    scored = pairs.select("p_partkey", fuzzy.score(fuzzy.token_sort, F.col("p_name"), F.col("old")).alias("r"))
    hit = scored.groupBy("p_partkey").agg(F.max("r").alias("closest"))
    return hit.withColumn("penalty", F.when(F.col("closest") >= 0.85, 0.25).otherwise(0.0))


@query(
    "publication_spacing",
    """WITH e AS (SELECT event_id, user_id, ts, epoch_us(ts) AS m FROM events), w AS (SELECT event_id, ts, m, count(*) OVER h AS in_hour, max(m) OVER b AS latest FROM e
      WINDOW h AS (PARTITION BY user_id ORDER BY m RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY user_id ORDER BY m RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT event_id, in_hour, make_timestamp(CASE WHEN event_id % 20 = 0 THEN m WHEN in_hour >= 3 THEN m + 2400000000 ELSE greatest(m, coalesce(latest + 1200000000, m)) END) AS slot FROM w""",
)
def publication_spacing(spark, sf_dir):
    urgent = F.when(F.col("event_id") % 20 == 0, 0.9).otherwise(0.1)
    return R.next_slot(events(spark, sf_dir), "ts", urgent, by=["user_id"]).select("event_id", "in_hour", F.col("slot").cast("timestamp_ntz").alias("slot"))


@query(
    "reward",
    """WITH s AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN (event_id % 7) / 6.0 END AS f, CASE WHEN event_id % 4 > 0 THEN (event_id % 11) / 10.0 END AS v, CASE WHEN event_id % 5 > 2 THEN (event_id % 3) / 2.0 END AS r, (event_id % 9) / 8.0 AS c FROM events),
    w AS (SELECT *, CASE WHEN f IS NULL THEN 0 ELSE 0.45 END + CASE WHEN v IS NULL THEN 0 ELSE 0.25 END + CASE WHEN r IS NULL THEN 0 ELSE 0.15 END AS w FROM s)
    SELECT event_id, CASE WHEN w > 0 THEN round(greatest(0, least(1, (coalesce(f, 0) * 0.45 + coalesce(v, 0) * 0.25 + coalesce(r, 0) * 0.15) / w * CASE WHEN c < 0.4 THEN greatest(0.2, 1.5 * c) ELSE 1 END)), 4) END AS reward FROM w""",
)
def reward(spark, sf_dir):
    k = F.col("event_id")
    f, v, r = F.when(k % 3 > 0, (k % 7) / 6), F.when(k % 4 > 0, (k % 11) / 10), F.when(k % 5 > 2, (k % 3) / 2)
    return events(spark, sf_dir).select("event_id", R.reward(f, v, r, F.lit(None).cast("double"), (k % 9) / 8).alias("reward"))


@query("bayes_mean", "SELECT user_id, round((coalesce(sum(value / 100), 0) + 2.5) / (count(value) + 5), 4) AS mean, round(count(value) / (count(value) + 5), 4) AS confidence FROM events GROUP BY user_id")
def bayes_mean(spark, sf_dir):
    x = F.col("value") / 100
    return events(spark, sf_dir).groupBy("user_id").agg(F.round(N.smoothed_mean(x), 4).alias("mean"), R.preference_confidence(F.count(x)).alias("confidence"))


@query(
    "preference_ewma",
    """WITH e AS (SELECT user_id, list({'x': value / 100, 'a': 0.15 * pow(0.5, date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') / 30)} ORDER BY event_id) AS l FROM events WHERE value IS NOT NULL GROUP BY user_id)
    SELECT user_id, round(list_reduce(list_prepend({'x': CAST(0.5 AS DOUBLE), 'a': CAST(0 AS DOUBLE)}, l), lambda s, e: {'x': (1 - e.a) * s.x + e.a * e.x, 'a': e.a}).x, 4) AS preference FROM e""",
)
def preference_ewma(spark, sf_dir):
    e = F.struct("event_id", (F.col("value") / 100).alias("x"), F.datediff(F.lit("2024-01-30").cast("date"), F.to_date("ts")).alias("age_days"))
    got = events(spark, sf_dir).where("value is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(e)).alias("l"))
    return got.select("user_id", F.round(R.preference(F.col("l")), 4).alias("preference"))


_EXP = "WITH e AS (SELECT user_id, avg(value) / 100 AS t, max(value) / 200 AS c, min(value) / 50 AS s, (user_id % 24) / 24.0 AS h FROM events GROUP BY user_id)"


@query("expected_standing", f"{_EXP} SELECT user_id, round(0.4 * t + 0.3 * c + 0.15 * s + 0.15 * h, 4) AS views, round(0.5 * t + 0.3 * s + 0.2 * c, 4) AS forwards, round(0.35 * t + 0.35 * s + 0.3 * h, 4) AS reactions, round(0.4 * t + 0.4 * s + 0.2 * h, 4) AS replies FROM e")
def expected_standing(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg((F.avg("value") / 100).alias("t"), (F.max("value") / 200).alias("c"), (F.min("value") / 50).alias("s"))
    x = R.expected(F.col("t"), F.col("c"), F.col("s"), (F.col("user_id") % 24) / 24)
    return e.select("user_id", x.alias("x")).select("user_id", "x.*")


@query(
    "bandit_arm",
    """WITH a AS (SELECT user_id, arm, (user_id * 7 + k * 3) % 10 / 10.0 AS f, (user_id * 3 + k * 7) % 10 / 10.0 AS v, (user_id + k) % 10 / 10.0 AS r, k FROM (SELECT DISTINCT user_id FROM events), (VALUES ('STANDARD', 0), ('BREAKING', 1), ('ANALYSIS', 2), ('DATA', 3)) t(arm, k)),
    s AS (SELECT *, round(0.4 * f + 0.35 * v + 0.25 * r, 6) AS score FROM a) SELECT user_id, arg_min(arm, (-score, k)) AS arm, max(score) AS score FROM s GROUP BY user_id""",
)
def bandit_arm(spark, sf_dir):
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(k).alias("k")) for k, a in enumerate(["STANDARD", "BREAKING", "ANALYSIS", "DATA"])])
    a = events(spark, sf_dir).select("user_id").distinct().select("user_id", F.inline(arms))
    u, k = F.col("user_id"), F.col("k")
    a = a.withColumns({"forwards": (u * 7 + k * 3) % 10 / 10, "views": (u * 3 + k * 7) % 10 / 10, "reactions": (u + k) % 10 / 10})
    return R.best_arm(a, ["user_id"], "arm", "k")


@query(
    "media_scores",
    """WITH m AS (SELECT p_partkey, p_size * 30 AS w, 400 + (p_partkey % 5) * 100 AS h, p_partkey % 4 = 0 AS prim FROM part), r AS (SELECT *, round(w / h, 4) AS ratio FROM m)
    SELECT p_partkey, round(0.5 + CASE WHEN w >= 800 THEN 0.2 WHEN w >= 500 THEN 0.1 WHEN w > 0 AND w < 250 THEN -0.35 ELSE 0 END + CASE WHEN ratio BETWEEN 1.3 AND 1.9 THEN 0.2 WHEN ratio < 0.6 OR ratio > 2.5 THEN -0.3 ELSE 0 END + CAST(CASE WHEN prim THEN 0.1 ELSE 0 END AS DOUBLE), 4) AS score FROM r""",
)
def media_scores(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", R.media_score(F.col("p_size") * 30, 400 + (k % 5) * 100, k % 4 == 0).alias("score"))


@query(
    "headline_choice",
    """WITH h AS (SELECT item_id, 0 AS k, split_part(text, '.', 1) AS t, 0.15 AS fit FROM benchmark UNION ALL SELECT item_id, 1, 'You won''t believe ' || substr(text, 1, 40), 0.2 FROM benchmark UNION ALL SELECT item_id, 2, substr(text, 1, 8), 0.2 FROM benchmark),
    s AS (SELECT item_id, k, t, round(greatest(0, 1.0 - CASE WHEN length(t) < 10 THEN 0.5 ELSE 0 END - CASE WHEN length(t) > 120 THEN 0.2 ELSE 0 END - CASE WHEN regexp_matches(t, '(?i)believe') THEN 0.6 ELSE 0 END - CASE WHEN regexp_matches(t, '!{2,}') THEN 0.6 ELSE 0 END + CAST(fit AS DOUBLE)), 4) AS score FROM h)
    SELECT item_id, arg_min(t, (-score, k)) AS headline, max(score) AS score FROM s GROUP BY item_id""",
)
def headline_choice(spark, sf_dir):
    t = F.col("text")
    options = [(F.split_part("text", F.lit("."), F.lit(1)), 0.15), (F.concat(F.lit("You won't believe "), F.substring(t, 1, 40)), 0.2), (F.substring(t, 1, 8), 0.2)]
    score = lambda x, fit: R.headline_score(x, F.lit(fit), ["(?i)believe", "!{2,}"])
    rows = F.array(*[F.struct((-score(x, fit)).alias("neg"), F.lit(i).alias("k"), x.alias("t")) for i, (x, fit) in enumerate(options)])
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_min(rows).alias("m")).select("item_id", F.col("m.t").alias("headline"), (-F.col("m.neg")).alias("score"))


@query(
    "illegal_transitions",
    """WITH t AS (SELECT conv_id, turn, ['discovered', 'watching', 'rising', 'breaking', 'peaking', 'cooling', 'stale', 'archived'][1 + length(text) % 8] AS state FROM conversations),
    l AS (SELECT conv_id, turn, state, lag(state) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t),
    ok(a, b) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, to in MO.TRANSITIONS.items() for b in to) + """)
    SELECT conv_id, turn, before, state FROM l WHERE before IS NOT NULL AND before <> state AND NOT EXISTS (SELECT 1 FROM ok WHERE a = before AND b = state)""",
)
def illegal_transitions(spark, sf_dir):
    states = F.array(*map(F.lit, MO.TRANSITIONS))
    t = table(spark, sf_dir, "conversations").withColumn("state", F.element_at(states, F.length("text") % 8 + 1))
    t = t.withColumn("before", F.lag("state").over(W.partitionBy("conv_id").orderBy("turn")))
    return t.where(F.col("before").isNotNull() & MO.illegal_transition(F.col("before"), F.col("state"))).select("conv_id", "turn", "before", "state")
