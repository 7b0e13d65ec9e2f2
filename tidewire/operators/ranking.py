"""News value, audience fit, gates, publish priority, novelty, editorial actions, rewards and learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.functions import numbers as N


def newsworthiness(observed: Column, independent: Column, importance=None, impact=None, utility=None, novelty=None, urgency=None, credibility=None) -> Column:
    """Six parts, each with a fallback where no analysis gives it."""
    known = lambda c, other: other if c is None else F.coalesce(c, other)
    one = F.lit(1.0)
    parts = [
        (known(importance, F.least(one, 0.40 + 0.15 * F.least(F.lit(4), observed))), 0.25), (known(impact, F.lit(0.5)), 0.20),
        (known(utility, F.lit(0.5)), 0.15), (known(novelty, F.lit(0.7)), 0.15), (known(urgency, F.lit(0.5)), 0.10),
        (known(credibility, F.least(one, 0.40 + 0.20 * F.least(F.lit(3), independent))), 0.15),
    ]
    return N.clamp01(sum((c * w for c, w in parts), F.lit(0.0)))


def audience_fit(topic_weight: Column, preference: Column, language: Column) -> Column:
    topic = F.coalesce(F.least(F.lit(1.0), topic_weight / 2), F.lit(0.5))
    return N.clamp01(0.40 * topic + 0.30 * F.coalesce(preference, F.lit(0.5)) + 0.15 * 0.60 + 0.15 * F.when(language.isin("fa", "en"), 1.0).otherwise(0.5))


def final_score(value, momentum, audience, fresh, places: int = 4) -> Column:
    return N.clamp01(0.45 * value + 0.30 * momentum + 0.20 * audience + 0.05 * fresh, places)


def credibility(trust: Column, independent: Column, model: Column, conflict: Column) -> Column:
    return N.clamp01(0.45 * trust + 0.25 * F.least(F.lit(1.0), independent / 3) + 0.30 * F.coalesce(model, F.lit(0.5)) - 0.25 * F.coalesce(conflict, F.lit(0.0)))


def gate(credibility: Column, conflict: Column, independent: Column, trust: Column) -> Column:
    """pass, or why not."""
    return (
        F.when(credibility < 0.25, "low_credibility").when(F.coalesce(conflict, F.lit(0.0)) >= 0.60, "high_conflict")
        .when((independent <= 1) & (trust < 0.30), "single_weak_source").otherwise("pass")
    )


NOVELTY = {"NEW": 1.0, "MATERIAL": 0.90, "CORRECTION": 0.90}


def priority(news, momentum, acceleration, audience, fresh, independent, novelty, saturation, repetition, credibility, places: int = 4) -> Column:
    novel = F.lit(0.10)
    for k, v in NOVELTY.items():
        novel = F.when(novelty == k, v).otherwise(novel)
    raw = 0.35 * news + 0.20 * momentum + 0.10 * acceleration + 0.15 * audience + 0.05 * fresh + 0.10 * N.saturating(independent) + 0.05 * novel
    boost = F.when(novelty == "CORRECTION", 0.10).otherwise(0.0)
    return N.clamp01(raw + boost - saturation - repetition - F.greatest(F.lit(0.0), 0.40 - credibility), places)


def topic_saturation(publications: DataFrame, topic: str, at: str, statuses: Column, hours: int = 4) -> DataFrame:
    """publications with recent (others of the topic in the hours before) and penalty: from two on, 0.10 for each beyond
    the first, at most 0.30."""
    w = W.partitionBy(topic).orderBy(F.unix_micros(at)).rangeBetween(-hours * 3_600_000_000, 0)
    recent = F.sum(statuses.cast("int")).over(w) - statuses.cast("int")
    out = publications.withColumn("recent", F.when(F.col(topic).isNotNull(), recent).otherwise(0))
    return out.withColumn("penalty", F.when(F.col("recent") >= 2, F.round(F.least(F.lit(0.30), 0.10 * (F.col("recent") - 1)), 2)).otherwise(0.0))


def novelty(published: Column, label: Column, new_facts: Column) -> Column:
    """published: whether the channel has the story already; label and new_facts: of the latest update decision."""
    return (
        F.when(~published, "NEW").when(label.isNull(), "REPEAT").when(label == "CORRECTION", "CORRECTION")
        .when(label.isin("MATERIAL_UPDATE", "MAJOR_BREAKING_UPDATE") | (F.coalesce(new_facts, F.lit(0)) > 0), "MATERIAL")
        .when(label == "MINOR_UPDATE", "MINOR").otherwise("REPEAT")
    )


def editorial(gate, novelty, priority, breaking, independent, news, acceleration) -> Column:
    watch = ((independent < 2) & (news >= 0.70)) | ((acceleration >= 0.70) & (priority < 0.68)) | ((priority >= 0.50) & (priority < 0.68) & (independent <= 1))
    update = F.when(priority >= 0.52, F.when(breaking, "PUBLISH_NOW").otherwise("UPDATE_EXISTING_STORY")).otherwise("SKIP")
    return (
        F.when(gate != "pass", "REJECT").when(novelty.isin("REPEAT", "MINOR"), "SKIP").when(novelty.isin("MATERIAL", "CORRECTION"), update)
        .when(watch, "WATCH").when((breaking & (priority >= 0.58)) | (priority >= 0.68), "PUBLISH_NOW").when(priority >= 0.52, "SCHEDULE").otherwise("SKIP")
    )


def legacy_action(action: Column) -> Column:
    return F.when(action.isin("PUBLISH_NOW", "UPDATE_EXISTING_STORY", "SCHEDULE"), "publish").when(action.isin("WATCH", "REJECT"), "hold").otherwise("skip")


def next_slot(publications: DataFrame, at: str, urgency: Column, gap_minutes: int = 20, cap: int = 3, wait_minutes: int = 40, by: list[str] = ()) -> DataFrame:
    """publications with slot: at once if urgent; after `cap` in the last hour `wait_minutes` on; else `gap_minutes` after the
    latest one at least."""
    micros = F.unix_micros(at)
    w = W.partitionBy(*by).orderBy(micros)
    hour = F.count(F.lit(1)).over(w.rangeBetween(-3_600_000_000, -1))
    latest = F.max(micros).over(w.rangeBetween(W.unboundedPreceding, -1))
    slot = F.when(urgency >= 0.85, micros).when(hour >= cap, micros + wait_minutes * 60_000_000).otherwise(F.greatest(micros, F.coalesce(latest + gap_minutes * 60_000_000, micros)))
    return publications.withColumn("in_hour", hour).withColumn("slot", F.timestamp_micros(slot))


def reward(forwards, views, reactions, replies, credibility) -> Column:
    """Weighted standing of known metrics, damped where credibility is low; null if no metric is known."""
    raw = N.blend([(forwards, 0.45), (views, 0.25), (reactions, 0.15), (replies, 0.15)])
    guard = F.when(credibility < 0.40, F.greatest(F.lit(0.20), 1.5 * credibility)).otherwise(1.0)
    return F.when(raw.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * guard)), 4))


def preference(events: Column) -> Column:
    """Fold an ordered array of (x, age_days): alpha = 0.15 halved every 30 days of age; starts at one half."""
    return F.aggregate(events, F.lit(0.5), lambda s, e: (1 - 0.15 * N.half_life(e["age_days"])) * s + 0.15 * N.half_life(e["age_days"]) * e["x"])


def preference_confidence(n: Column) -> Column:
    return F.round(n / (n + 5), 4)


def expected(topic, content, source, hour) -> Column:
    """Expected standing of a post by metric."""
    return F.struct(
        F.round(0.40 * topic + 0.30 * content + 0.15 * source + 0.15 * hour, 4).alias("views"), F.round(0.50 * topic + 0.30 * source + 0.20 * content, 4).alias("forwards"),
        F.round(0.35 * topic + 0.35 * source + 0.30 * hour, 4).alias("reactions"), F.round(0.40 * topic + 0.40 * source + 0.20 * hour, 4).alias("replies"),
    )


def best_arm(arms: DataFrame, by: list[str], arm: str, order: str) -> DataFrame:
    score = F.round(0.40 * F.col("forwards") + 0.35 * F.col("views") + 0.25 * F.col("reactions"), 6)
    return arms.groupBy(*by).agg(F.min_by(F.col(arm), F.struct(-score, F.col(order))).alias(arm), F.max(score).alias("score"))


def explore(best: Column, arms: list[str], key: Column, epsilon: float = 0.05, seed: int = 7) -> Column:
    """With probability epsilon, by the hash of key, another arm than the best one may come up."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) / 10_000
    return F.when(u < epsilon, F.element_at(F.array(*map(F.lit, arms)), (F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(len(arms))) + 1).cast("int"))).otherwise(best)


def headline_score(text: Column, format_fit: Column, clickbait: list[str]) -> Column:
    s = F.lit(1.0) - F.when(F.length(text) < 10, 0.5).otherwise(0.0) - F.when(F.length(text) > 120, 0.2).otherwise(0.0)
    for p in clickbait:
        s = s - F.when(text.rlike(p), 0.6).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), s + format_fit), 4)


def media_score(width: Column, height: Column, primary: Column) -> Column:
    ratio = F.round(width / F.nullif(height, F.lit(0)), 4)
    size = F.when(width >= 800, 0.20).when(width >= 500, 0.10).when((width > 0) & (width < 250), -0.35).otherwise(0.0)
    shape = F.when((ratio >= 1.30) & (ratio <= 1.90), 0.20).when((ratio < 0.6) | (ratio > 2.5), -0.30).otherwise(0.0)
    return F.round(0.50 + size + shape + F.when(primary, 0.10).otherwise(0.0), 4)
