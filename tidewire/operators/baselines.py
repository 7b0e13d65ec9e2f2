"""Engagement baselines: percentiles by context, lookup with fallback, and standing within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.numbers import PERCENTILES

# Fallback levels, each with the keys it matches, the least sample count, its confidence and its name.
LEVELS = [
    (["source", "topic", "subtopic", "content_type"], 10, 0.95, "source_topic_subtopic_type"),
    (["source", "topic", "content_type"], 10, 0.85, "source_topic_type"),
    (["source", "content_type"], 5, 0.70, "source_type"),
    (["source"], 5, 0.55, "source"),
    (["platform"], 0, 0.35, "platform"),
]


def percentiles(rows: DataFrame, keys: list, value: Column, places: int = 4) -> DataFrame:
    """keys, p25..p99 (exact, linear), sample_count, confidence = min(1, n / 30)."""
    got = rows.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(p) for _, p in PERCENTILES])).alias("p"), F.count(value).alias("sample_count"))
    names = [c for c in got.columns if c not in ("p", "sample_count")]
    return got.select(*names, *[F.round(F.col("p")[i], places).alias(n) for i, (n, _) in enumerate(PERCENTILES)], "sample_count",
                      F.round(F.least(F.lit(1.0), F.col("sample_count") / 30), 4).alias("confidence"))


def fallback(items: DataFrame, baselines: DataFrame, levels=None, also: tuple[str, ...] = ("bucket", "metric")) -> DataFrame:
    """items with baseline_id, level and level_confidence: at each level the baseline of the lowest id counts, and only if
    its samples suffice; the first level that gives one wins. None: null, `none`, 0."""
    out, ids = items, []
    for k, (keys, least, confidence, name) in enumerate(levels or LEVELS):
        on = [*keys, *also]
        first = baselines.groupBy(*on).agg(F.min_by(F.struct("baseline_id", "sample_count"), "baseline_id").alias(f"__b{k}"))
        first = first.select(*[F.col(c).alias(f"__{k}{c}") for c in on], F.when(F.col(f"__b{k}.sample_count") >= least, F.col(f"__b{k}.baseline_id")).alias(f"__i{k}"))
        same = F.lit(True)
        for c in on:
            same = same & (F.col(c) == F.col(f"__{k}{c}"))
        out = out.join(first, same, "left").drop(*[f"__{k}{c}" for c in on])
        ids.append((F.col(f"__i{k}"), name, confidence))
    level, sure = F.lit("none"), F.lit(0.0)
    for c, name, confidence in reversed(ids):
        level, sure = F.when(c.isNotNull(), name).otherwise(level), F.when(c.isNotNull(), confidence).otherwise(sure)
    return out.select(*items.columns, F.coalesce(*[c for c, _, _ in ids]).alias("baseline_id"), level.alias("level"), sure.alias("level_confidence"))
