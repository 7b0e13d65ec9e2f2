"""Baselines and time series over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import numbers as N
from tidewire.operators import baselines as B
from tidewire.operators import momentum as MO
from tidewire.operators import ranks as R
from tidewire.operators import series as S
from tidewire.plans.base import AS_OF, as_of, events, query
from tidewire.session import table

_P = [("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)]
_PSQL = ", ".join(f"round(quantile_cont(value, {v}), 4) AS {n}" for n, v in _P)
_CONF = "count(value) AS sample_count, round(least(1.0, count(value) / 30), 4) AS confidence"


@query("baseline_percentiles", f"SELECT event_type, user_id % 7 AS source, {_PSQL}, {_CONF} FROM events GROUP BY ALL")
def baseline_percentiles(spark, sf_dir):
    return B.percentiles(events(spark, sf_dir), ["event_type", (F.col("user_id") % 7).alias("source")], F.col("value"))


@query("baseline_levels", f"SELECT event_type, user_id % 7 AS source, {_PSQL}, {_CONF} FROM events GROUP BY GROUPING SETS ((event_type, user_id % 7), (event_type), ())")
def baseline_levels(spark, sf_dir):
    """All fallback levels in one pass, by grouping sets."""
    e = events(spark, sf_dir).select("event_type", (F.col("user_id") % 7).alias("source"), "value")
    a = e.groupingSets([["event_type", "source"], ["event_type"], []], "event_type", "source")
    got = a.agg(F.percentile("value", F.array(*[F.lit(v) for _, v in _P])).alias("p"), F.count("value").alias("sample_count"))
    return got.select("event_type", "source", *[F.round(F.col("p")[i], 4).alias(n) for i, (n, _) in enumerate(_P)], "sample_count", F.round(F.least(F.lit(1.0), F.col("sample_count") / 30), 4).alias("confidence"))


@query(
    "baseline_fallback",
    """WITH e AS (SELECT event_id, user_id AS source, event_type AS content_type, user_id % 3 AS topic, CAST(extract(hour FROM ts) AS INTEGER) % 4 AS bucket FROM events),
    l1 AS (SELECT source, topic, content_type, bucket, count(*) AS n FROM e GROUP BY ALL), l2 AS (SELECT source, content_type, bucket, count(*) AS n FROM e GROUP BY ALL), l3 AS (SELECT source, bucket, count(*) AS n FROM e GROUP BY ALL)
    SELECT event_id, CASE WHEN l1.n >= 10 THEN 'source_topic_type' WHEN l2.n >= 8 THEN 'source_type' WHEN l3.n >= 5 THEN 'source' ELSE 'none' END AS level,
      CASE WHEN l1.n >= 10 THEN 0.85 WHEN l2.n >= 8 THEN 0.7 WHEN l3.n >= 5 THEN 0.55 ELSE CAST(0.0 AS DOUBLE) END AS level_confidence
    FROM e LEFT JOIN l1 USING (source, topic, content_type, bucket) LEFT JOIN l2 USING (source, content_type, bucket) LEFT JOIN l3 USING (source, bucket)""",
)
def baseline_fallback(spark, sf_dir):
    """The first level whose samples suffice. Baselines of each level carry the level's keys only."""
    e = events(spark, sf_dir).select("event_id", F.col("user_id").alias("source"), F.col("event_type").alias("content_type"), (F.col("user_id") % 3).alias("topic"), (F.hour("ts") % 4).alias("bucket"), F.lit("views").alias("metric"))
    out, ids = e, []
    levels = [(["source", "topic", "content_type"], 10, 0.85, "source_topic_type"), (["source", "content_type"], 8, 0.70, "source_type"), (["source"], 5, 0.55, "source")]
    for k, (keys, least, confidence, name) in enumerate(levels):
        base = e.groupBy(*keys, "bucket", "metric").agg(F.count(F.lit(1)).alias("sample_count")).withColumn("baseline_id", F.xxhash64(*keys, "bucket"))
        out = B.fallback(out, base, [(keys, least, confidence, name)]).withColumnsRenamed({"baseline_id": f"b{k}", "level": f"l{k}", "level_confidence": f"c{k}"})
        ids.append(k)
    some = lambda c: F.coalesce(*[F.when(F.col(f"b{k}").isNotNull(), F.col(f"{c}{k}")) for k in ids])
    return out.select("event_id", F.coalesce(some("l"), F.lit("none")).alias("level"), F.coalesce(some("c"), F.lit(0.0)).alias("level_confidence"))


_INV = """CASE WHEN value <= p25 THEN CASE WHEN p25 <= 0 THEN 0.25 ELSE round(0.25 * value / p25, 4) END WHEN value <= p50 THEN round(0.25 + 0.25 * (value - p25) / coalesce(nullif(p50 - p25, 0), 1), 4)
  WHEN value <= p75 THEN round(0.5 + 0.25 * (value - p50) / coalesce(nullif(p75 - p50, 0), 1), 4) WHEN value <= p90 THEN round(0.75 + 0.15 * (value - p75) / coalesce(nullif(p90 - p75, 0), 1), 4)
  WHEN value <= p95 THEN round(0.9 + 0.05 * (value - p90) / coalesce(nullif(p95 - p90, 0), 1), 4) WHEN value <= p99 THEN round(0.95 + 0.04 * (value - p95) / coalesce(nullif(p99 - p95, 0), 1), 4) ELSE 0.9999 END"""


@query(
    "inverse_percentile",
    f"""WITH b AS (SELECT event_type, {_PSQL} FROM events GROUP BY event_type) SELECT event_id, {_INV} AS standing,
      CASE WHEN value <= p25 THEN 0.25 WHEN value <= p50 THEN 0.5 WHEN value <= p75 THEN 0.75 WHEN value <= p90 THEN 0.9 WHEN value <= p95 THEN 0.95 WHEN value <= p99 THEN 0.99 ELSE CAST(0.9999 AS DOUBLE) END AS step
    FROM events JOIN b USING (event_type) WHERE value IS NOT NULL""",
)
def inverse_percentile(spark, sf_dir):
    e = events(spark, sf_dir).where("value is not null")
    b = B.percentiles(e, ["event_type"], F.col("value")).drop("sample_count", "confidence")
    p = {n: F.col(n) for n, _ in _P}
    return e.join(b, "event_type").select("event_id", N.inverse_percentile(F.col("value"), p).alias("standing"), N.step_percentile(F.col("value"), p).alias("step"))


@query("nearest_bucket", "SELECT event_id, CAST(list_sort([[abs(event_id % 1500 - m), m] FOR m IN [10, 30, 60, 180, 360, 720, 1440]])[1][2] AS INTEGER) AS bucket FROM events")
def nearest_bucket(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", N.nearest_milestone(F.col("event_id") % 1500).cast("int").alias("bucket"))


def _snapshots(spark, sf_dir):
    """Running counts of each user's events as snapshots: views and reactions so far."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    of = lambda t: F.sum((F.col("event_type") == t).cast("long")).over(w)
    return events(spark, sf_dir).select("user_id", "ts", "event_id", of("view").alias("views"), of("click").alias("clicks"), F.col("value"))


_SNAP = """snaps AS (SELECT user_id, ts, event_id, value, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS views,
  CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS clicks FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""
_ORD = "(PARTITION BY user_id ORDER BY event_id)"


@query(
    "interval_velocity",
    f"""WITH {_SNAP}, v AS (SELECT user_id, event_id, views - lag(views) OVER {_ORD} AS d, greatest(0.001, (epoch_us(ts) - epoch_us(lag(ts) OVER {_ORD})) / 3600000000) AS h FROM snaps)
    SELECT user_id, event_id, round(greatest(0, d) / h, 4) AS velocity FROM v""",
)
def interval_velocity(spark, sf_dir):
    from pyspark.sql.window import Window as W

    s = _snapshots(spark, sf_dir)
    w = W.partitionBy("user_id").orderBy("event_id")
    gap = F.greatest(F.lit(0.001), (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / F.lit(3_600_000_000))
    return s.select("user_id", "event_id", F.round(F.greatest(F.lit(0), F.col("views") - F.lag("views").over(w)) / gap, 4).alias("velocity"))


@query(
    "value_velocity",
    """WITH d AS (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL), v AS (SELECT user_id, ts, greatest(0, value - lag(value) OVER w) AS d, lag(value) OVER w IS NOT NULL AS known, greatest(0.001, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3600000000) AS h
      FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, ts, round(d / h, 4) AS velocity FROM v WHERE known""",
)
def value_velocity(spark, sf_dir):
    """A counter that falls back counts as no change."""
    d = events(spark, sf_dir).groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    v = S.interval_velocity(d, "user_id", "ts", "value").where("velocity is not null")
    return v.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "velocity")


@query(
    "ewma_values",
    """WITH o AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id)
    SELECT user_id, round(list_reduce(v, lambda s, x: 0.3 * x + 0.7 * s), 4) AS smooth FROM o""",
)
def ewma_values(spark, sf_dir):
    o = S.ordered(events(spark, sf_dir).where("value is not null"), "user_id", "event_id", F.col("value"), "v")
    return o.select("user_id", F.round(S.ewma(F.col("v")), 4).alias("smooth"))


@query(
    "acceleration",
    """WITH d AS (SELECT user_id, ts, max(value) AS value FROM events GROUP BY ALL), r AS (SELECT user_id, value - lead(value) OVER w AS d, greatest(0.01, (epoch_us(ts) - epoch_us(lead(ts) OVER w)) / 3600000000) AS h, row_number() OVER w AS n
      FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC)) SELECT user_id, round(greatest(-2.0, least(2.0, d / h)), 4) AS acceleration FROM r WHERE n = 1""",
)
def acceleration(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return S.last_two_change(d, "user_id", "ts", "value")


@query(
    "nearest_snapshot",
    """WITH a AS (SELECT user_id, event_id, value, date_diff('second', min(ts) OVER (PARTITION BY user_id), ts) AS age FROM events)
    SELECT user_id, arg_min(event_id, (abs(age - 3600), age, event_id)) AS event_id, min(abs(age - 3600)) AS distance FROM a GROUP BY user_id""",
)
def nearest_snapshot(spark, sf_dir):
    e = events(spark, sf_dir)
    first = e.groupBy("user_id").agg(F.min("ts").alias("first"))
    a = e.join(first, "user_id").select("user_id", (F.unix_seconds("ts") - F.unix_seconds("first")).alias("age"), "event_id")
    a = a.groupBy("user_id", "age").agg(F.min("event_id").alias("event_id"))
    return S.nearest_capture(a, "user_id", "age", F.lit(3600)).select("user_id", "event_id", F.abs(F.col("age") - 3600).alias("distance"))


@query(
    "arrivals_5_15_30",
    f"""SELECT event_type, {', '.join(f"CAST(count(*) FILTER (WHERE ts <= TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL {m} MINUTE) AS BIGINT) AS arrivals_{m}" for m in (5, 15, 30))} FROM events GROUP BY event_type""",
)
def arrivals_5_15_30(spark, sf_dir):
    return S.arrivals(events(spark, sf_dir), ["event_type"], "ts", as_of())


@query("freshness", f"SELECT event_id, greatest(0.0001, round(pow(0.5, greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 3600000000) / 24), 4)) AS freshness FROM events")
def freshness(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", N.freshness(as_of(), F.col("ts")).alias("freshness"))


_STORY = f"""story AS (SELECT user_id, count(*) AS items, count(DISTINCT event_type) AS indep, count(*) FILTER (WHERE ts <= TIMESTAMP '{AS_OF}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE) AS arr15,
  round(greatest(0, least(1, avg(value) / 100)), 4) AS vel, round(greatest(-1, least(1, (max(value) - avg(value)) / 100)), 4) AS acc,
  greatest(0.0001, round(pow(0.5, greatest(0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 3600000000) / 24), 4)) AS fresh FROM events GROUP BY user_id)"""
_MOM = """round(greatest(0, least(1, 0.25 * CASE WHEN vel = 0 THEN 0.5 ELSE vel END + 0.20 * round(greatest(0, least(1, 0.5 + 0.5 * acc)), 4) + 0.20 * round(1 - exp(-0.7 * indep), 4) + 0.15 * least(1, arr15 / 3)
  + 0.10 * least(1, least(10, items) / 6) + 0.10 * fresh)), 4)"""


def _stories(spark, sf_dir):
    e = events(spark, sf_dir)
    age = F.unix_micros(as_of()) - F.unix_micros("ts")
    s = e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("items"), F.countDistinct("event_type").alias("indep"), F.count_if((age >= 0) & (age <= 900_000_000)).alias("arr15"),
        N.clamp01(F.avg("value") / 100).alias("vel"), F.round(F.greatest(F.lit(-1), F.least(F.lit(1), (F.max("value") - F.avg("value")) / 100)), 4).alias("acc"), N.freshness(as_of(), F.max("ts")).alias("fresh"),
    )
    c = F.col
    return s.withColumn("momentum", MO.momentum(c("vel"), c("acc"), c("indep"), c("arr15"), c("items"), c("fresh"))).withColumn("sure", MO.confidence(c("items"), c("indep"), c("fresh")))


@query(
    "story_momentum",
    f"WITH {_STORY} SELECT user_id, {_MOM} AS momentum, round(greatest(0.1, 0.4 * least(1, items / 6) + 0.4 * least(1, indep / 3) + 0.2 * fresh), 4) AS confidence FROM story",
)
def story_momentum(spark, sf_dir):
    return _stories(spark, sf_dir).select("user_id", "momentum", F.col("sure").alias("confidence"))


_TREND = """CASE WHEN (mom >= 0.85 AND sure >= 0.40 AND items >= 2) OR (acc >= 0.40 AND indep >= 3 AND mom >= 0.75) THEN 'BREAKING' WHEN mom >= 0.75 AND acc >= 0.05 THEN 'SURGING' WHEN mom >= 0.60 AND acc >= 0 THEN 'RISING'
  WHEN acc >= 0.15 AND indep >= 2 AND sure >= 0.35 AND items <= 5 THEN 'EARLY_SIGNAL' WHEN items >= 8 AND acc <= -0.15 THEN 'SATURATED' WHEN acc <= -0.10 AND mom < 0.45 THEN 'COOLING' ELSE 'NORMAL' END"""


@query(
    "trend_and_lifecycle",
    f"""WITH {_STORY}, m AS (SELECT user_id, items, indep, round(acc - (user_id % 5) / 4.0, 4) AS acc, {_MOM} AS mom, round(greatest(0.1, 0.4 * least(1, items / 6) + 0.4 * least(1, indep / 3) + 0.2 * fresh), 4) AS sure FROM story),
    t AS (SELECT *, {_TREND} AS trend FROM m),
    l AS (SELECT user_id, trend, CASE WHEN trend = 'BREAKING' THEN 'breaking' WHEN trend IN ('RISING', 'SURGING') THEN CASE WHEN s = 'breaking' THEN 'peaking' ELSE 'rising' END WHEN trend = 'EARLY_SIGNAL' AND s IN ('discovered', 'stale') THEN 'watching'
      WHEN s IN ('breaking', 'rising') AND acc < -0.15 THEN 'peaking' WHEN s = 'peaking' AND mom < 0.5 THEN 'cooling' WHEN s = 'cooling' AND user_id * 3600 > 43200 AND mom < 0.3 THEN 'stale'
      WHEN s = 'stale' AND user_id * 3600 > 259200 THEN 'archived' WHEN s = 'discovered' THEN 'watching' ELSE s END AS state FROM (SELECT *, ['discovered', 'rising', 'breaking', 'peaking', 'cooling', 'stale'][1 + user_id % 6] AS s FROM t))
    SELECT user_id, trend, state, CAST(CASE trend WHEN 'BREAKING' THEN 60 WHEN 'SURGING' THEN 180 WHEN 'EARLY_SIGNAL' THEN 300 ELSE CASE state WHEN 'rising' THEN 300 WHEN 'breaking' THEN 60 WHEN 'cooling' THEN 1800 WHEN 'stale' THEN 3600 WHEN 'archived' THEN 86400 ELSE 600 END END AS INTEGER) AS next_seconds FROM l""",
)
def trend_and_lifecycle(spark, sf_dir):
    """One step of both machines from assorted states."""
    s = _stories(spark, sf_dir).withColumn("a", F.round(F.col("acc") - (F.col("user_id") % 5) / 4, 4))
    start = F.element_at(F.array(*map(F.lit, ["discovered", "rising", "breaking", "peaking", "cooling", "stale"])), (F.col("user_id") % 6 + 1).cast("int"))
    t = MO.trend(F.lit("NORMAL"), F.col("momentum"), F.col("a"), F.col("indep"), F.col("items"), F.col("sure"), F.col("items"))
    s = s.withColumn("trend", t).withColumn("state", MO.lifecycle(start, F.col("trend"), F.col("momentum"), F.col("a"), F.col("user_id") * 3600))
    return s.select("user_id", "trend", "state", MO.observation_interval(F.col("state"), F.col("trend")).alias("next_seconds"))


@query("trend_fold")
def trend_fold(spark, sf_dir):
    """Both machines folded over each user's days, with hysteresis."""
    e = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("items"), F.countDistinct("event_type").alias("indep"), F.avg("value").alias("v"))
    step = F.struct("day", N.clamp01(F.col("v") / 60).alias("mom"), (F.col("v") / 100 - 0.5).alias("acc"), F.col("indep").alias("independent"), F.col("items").alias("items"), F.lit(0.5).alias("sure"), F.lit(2).alias("samples"), (F.datediff("day", F.lit("2024-01-01")) * 86400).alias("age"))
    return e.groupBy("user_id").agg(MO.fold_states(F.array_sort(F.collect_list(step))).alias("s")).select("user_id", "s.trend", "s.state")


@query(
    "tumbling_counts",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
)
def tumbling_counts(spark, sf_dir):
    g = events(spark, sf_dir).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(
    "sliding_counts",
    """WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL (5 * k) MINUTE AS start, event_type FROM events, range(3) r(k)) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL""",
)
def sliding_counts(spark, sf_dir):
    g = events(spark, sf_dir).groupBy(F.window("ts", "15 minutes", "5 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "session_windows",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
    n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, k""",
)
def session_windows(spark, sf_dir):
    g = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("price_percentiles", f"SELECT l_returnflag, count(*) AS n, {_PSQL.replace('(value,', '(CAST(l_extendedprice AS DOUBLE),')} FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag")
def price_percentiles(spark, sf_dir):
    """Groups that hold a third of all rows each, by rank selection."""
    got = R.percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), dict(_P))
    return got.select("l_returnflag", "n", *[F.round(n, 4).alias(n) for n, _ in _P])
