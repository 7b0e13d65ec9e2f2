"""Time series of engagement snapshots: velocity, smoothing, acceleration, nearest capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def interval_velocity(rows: DataFrame, item: str, at: str, metric: str) -> DataFrame:
    """rows with velocity, per hour: the change since the last snapshot, a drop counting as 0, over at least 0.001 h; null
    where either side is unknown."""
    w = W.partitionBy(item).orderBy(at)
    gap = F.greatest(F.lit(0.001), (F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))) / F.lit(3_600_000_000))
    rise = F.greatest(F.lit(0), F.col(metric) - F.lag(metric).over(w))
    known = F.col(metric).isNotNull() & F.lag(metric).over(w).isNotNull()
    return rows.withColumn("velocity", F.when(known, F.round(rise / gap, 4)))


def ewma(values: Column, alpha: float = 0.30) -> Column:
    """Of an ordered array: exponentially weighted, seeded with the first value; null for an empty one."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(rest, values[0], lambda s, x: alpha * x + (1 - alpha) * s))


def ordered(rows: DataFrame, item: str, at: str, value: Column, to: str) -> DataFrame:
    """item, to: the values of each item by time."""
    return rows.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), value.alias("v")))), lambda x: x["v"]).alias(to))


def last_two_change(rows: DataFrame, item: str, at: str, value: str, least_hours: float = 0.01, limit: float = 2.0) -> DataFrame:
    """item, acceleration: the change of the last two values per hour, within +-limit; null for one row."""
    w = W.partitionBy(item).orderBy(F.desc(at))
    last = rows.select(item, value, at, F.lead(value).over(w).alias("__v"), F.lead(at).over(w).alias("__t"), F.row_number().over(w).alias("__n")).where("__n = 1")
    gap = F.greatest(F.lit(least_hours), (F.unix_micros(at) - F.unix_micros("__t")) / F.lit(3_600_000_000))
    change = (F.col(value) - F.col("__v")) / gap
    return last.select(item, F.round(F.greatest(F.lit(-limit), F.least(F.lit(limit), change)), 4).alias("acceleration"))


def nearest_capture(rows: DataFrame, item: str, age: str, target: Column) -> DataFrame:
    """Of each item the snapshot whose age is nearest to the target; of equally near ones the earliest."""
    rest = [c for c in rows.columns if c != item]
    return rows.groupBy(item).agg(F.min_by(F.struct(*rest), F.struct(F.abs(F.col(age) - target), F.col(age))).alias("r")).select(item, *[f"r.{c}" for c in rest])


def arrivals(rows: DataFrame, item: list, at: str, as_of: Column, minutes: tuple[int, ...] = (5, 15, 30)) -> DataFrame:
    """Counts of rows in the minutes before as_of."""
    age = F.unix_micros(as_of) - F.unix_micros(at)
    return rows.groupBy(*item).agg(*[F.count_if((age >= 0) & (age <= m * 60_000_000)).alias(f"arrivals_{m}") for m in minutes])
