"""Scores, decays, percentiles and schedules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Minutes after publication at which engagement is captured.
MILESTONES = [10, 30, 60, 180, 360, 720, 1440]
PERCENTILES = [("p25", 0.25), ("p50", 0.50), ("p75", 0.75), ("p90", 0.90), ("p95", 0.95), ("p99", 0.99)]


def clamp01(x: Column, places: int = 4) -> Column:
    """x in 0..1 to some places, after 9, so that a tie does not hang on the last bit; null, NaN and infinite values give 0."""
    x = x.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.round(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 9), places))


def hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000)


def time_proximity(a: Column, b: Column, scale: float = 36.0) -> Column:
    """exp(-hours / 36); a missing time gives one half."""
    return F.coalesce(F.exp(-F.abs(hours(a, b)) / scale), F.lit(0.5))


def freshness(as_of: Column, since: Column, half_life: float = 24.0) -> Column:
    """Halves every 24 hours, at least 0.0001; a missing time gives one half."""
    age = F.greatest(F.lit(0.0), hours(as_of, since))
    return F.coalesce(F.greatest(F.lit(0.0001), F.round(F.pow(F.lit(0.5), age / half_life), 4)), F.lit(0.5))


def saturating(n: Column, rate: float = 0.7) -> Column:
    return 1 - F.exp(-rate * n)


def overlap(a: Column, b: Column) -> Column:
    """Shared members over the smaller set's; 0 if one is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def mean_of_known(*xs: Column) -> Column:
    """The mean of the values that are not null; 0 if none is."""
    known = F.filter(F.array(*xs), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(0.0)


def blend(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the values that are not null, their weights renormalised; null if none is."""
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts), F.lit(0.0))
    total = sum((F.coalesce(x, F.lit(0.0)) * w for x, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or a zero vector; clamped to -1..1, 4 places."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))
    return F.when((F.size(a) == F.size(b)) & (size > 0), F.round(c, 4)).otherwise(0.0)


def inverse_percentile(v: Column, p: dict[str, Column]) -> Column:
    """Where v stands among the percentiles, linear within bands; null for null. Missing percentiles count as 0, and a
    band without width as 1 wide."""
    v = v.cast("double")
    q = {k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in p.items()}
    bands = [("p25", "p50", 0.25, 0.25), ("p50", "p75", 0.50, 0.25), ("p75", "p90", 0.75, 0.15), ("p90", "p95", 0.90, 0.05), ("p95", "p99", 0.95, 0.04)]
    out = F.when(v.isNull(), None).when(v <= q["p25"], F.when(q["p25"] <= 0, 0.25).otherwise(F.round(0.25 * v / q["p25"], 4)))
    for lo, hi, base, span in bands:
        width = F.coalesce(F.nullif(q[hi] - q[lo], F.lit(0.0)), F.lit(1.0))
        out = out.when(v <= q[hi], F.round(base + span * (v - q[lo]) / width, 4))
    return out.otherwise(0.9999)


def step_percentile(v: Column, p: dict[str, Column]) -> Column:
    """The same in steps: the first percentile that v does not exceed."""
    out = F.when(v.isNull(), None)
    for k, level in PERCENTILES:
        out = out.when(v <= p[k], level)
    return out.otherwise(0.9999)


def nearest_milestone(minutes: Column, schedule: list[int] = MILESTONES) -> Column:
    """The milestone nearest to an age; of equally near ones the smaller."""
    by = F.transform(F.array(*map(F.lit, schedule)), lambda m: F.struct(F.abs(minutes - m).alias("d"), m.alias("m")))
    return F.array_min(by)["m"]


def next_milestone(age_seconds: Column, schedule: list[int] = MILESTONES) -> Column:
    """The first milestone that an age has not reached; null after the last."""
    return F.array_min(F.filter(F.array(*map(F.lit, schedule)), lambda m: m * 60 > age_seconds))


def parse_schedule(text: Column) -> Column:
    """Positive whole minutes of a comma-separated list, distinct and in order."""
    numbers = F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"\s", "").try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x > 0)))


def counter(x: Column) -> Column:
    """A platform's counter as a long: null if it is no number or negative. Unknown is never 0."""
    n = x.try_cast("bigint")
    return F.when(n >= 0, n)


def smoothed_mean(values: Column, prior: float = 0.5, strength: float = 5.0) -> Column:
    return (F.coalesce(F.sum(values), F.lit(0.0)) + prior * strength) / (F.count(values) + strength)


def half_life(x: Column, days: float = 30.0) -> Column:
    return F.pow(F.lit(0.5), x / days)


def preference(x: Column, places: int = 6) -> Column:
    """x within 0 to 1; one half if it is missing or no number."""
    bad = x.isNull() | F.isnan(x)
    return F.when(bad, 0.5).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), places))


def share(weight: Column, places: int = 4) -> Column:
    """Each weight's part of all; for tables of settings, of which there are few."""
    return F.round(weight / F.sum(weight).over(W.partitionBy()), places)
