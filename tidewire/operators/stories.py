"""What is known of a story from its members: times, metrics, representatives, momentum inputs, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def effective_time(published: Column, updated: Column) -> Column:
    """The later of two times; the known one if only one is known."""
    return F.greatest(published, updated)


def story_times(members: DataFrame, story: str, published: Column, updated: Column) -> DataFrame:
    """story, first (earliest publication), latest (latest effective time)."""
    return members.groupBy(story).agg(F.min(published).alias("first"), F.max(effective_time(published, updated)).alias("latest"))


def nearest_gap_hours(members: DataFrame, story: str, at: str, to: str = "gap_hours") -> DataFrame:
    """members with the hours to the nearest other member of the story; null if no time is known or no other has one.

    Of sorted times the nearest is a neighbour, so one window does what a comparison with all members would.
    """
    w = W.partitionBy(story, F.col(at).isNull()).orderBy(at)
    before, after = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w)), F.unix_micros(F.lead(at).over(w)) - F.unix_micros(at)
    return members.withColumn(to, F.round(F.least(before, after) / 3.6e9, 4))


def representatives(members: DataFrame, story: str, primary: str, updated: str, added: str, key: str, most: int = 8) -> DataFrame:
    """The members that stand for a story: primary first, then the latest updated, the latest added, the least key."""
    order = [F.desc(primary), F.desc_nulls_last(updated), F.desc_nulls_last(added), F.asc(key)]
    return members.withColumn("rank", F.row_number().over(W.partitionBy(story).orderBy(*order))).where(F.col("rank") <= most)


def union_of_arrays(members: DataFrame, story: str, rank: str, arrays: str, members_most: int, values_most: int) -> DataFrame:
    """story, values: the sorted distinct values of the first members' arrays, the first so many of them."""
    some = members.where(F.col(rank) <= members_most).select(story, F.explode(arrays).alias("__x")).distinct()
    firsts = some.withColumn("__n", F.row_number().over(W.partitionBy(story).orderBy("__x"))).where(F.col("__n") <= values_most)
    return firsts.groupBy(story).agg(F.array_sort(F.collect_list("__x")).alias("values"))  # at most values_most


def metric_maxima(members: DataFrame, story: str, metrics: list[str]) -> DataFrame:
    """The largest known value of each metric; null where no member has one."""
    return members.groupBy(story).agg(*[F.max(m).alias(m) for m in metrics])


def diversity(members: DataFrame, story: str, source: str, platform: str) -> DataFrame:
    """story, source_diversity (distinct sources an item), platform_diversity (distinct platforms out of four)."""
    got = members.groupBy(story).agg(F.countDistinct(source).alias("s"), F.countDistinct(platform).alias("p"), F.count(F.lit(1)).alias("n"))
    of = lambda x: F.round(F.least(F.lit(1.0), x), 4)
    return got.select(story, of(F.col("s") / F.col("n")).alias("source_diversity"), of(F.col("p") / 4).alias("platform_diversity"))


def ranking_momentum(members: DataFrame, story: str, relative: str, velocity: str, acceleration: str, independent: Column, conflict: Column) -> DataFrame:
    """story, relative_performance, engagement_velocity, engagement_acceleration, spread, consistency, momentum.

    Relative performance is averaged, velocity (of 500 an hour) and acceleration (of 100) are at their largest; unknown
    ones are 0.5, 0.2 and 0.2.
    """
    # An unknown value stays unknown: greatest and least alone would skip it.
    of = lambda x, top: F.when(F.col(x).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(x) / top)))
    got = members.groupBy(story).agg(
        F.coalesce(F.avg(relative), F.lit(0.5)).alias("r"),
        F.coalesce(F.max(of(velocity, 500.0)), F.lit(0.2)).alias("v"),
        F.coalesce(F.max(of(acceleration, 100.0)), F.lit(0.2)).alias("a"),
        F.round(1 - F.exp(-0.7 * F.max(independent)), 4).alias("spread"),
        F.when(F.max(conflict), 0.2).otherwise(0.85).alias("consistency"),
    )
    total = 0.4 * F.col("r") + 0.2 * F.col("v") + 0.1 * F.col("a") + 0.2 * F.col("spread") + 0.1 * F.col("consistency")
    return got.select(
        story, F.round("r", 4).alias("relative_performance"), F.round("v", 4).alias("engagement_velocity"),
        F.round("a", 4).alias("engagement_acceleration"), "spread", "consistency", F.round(total, 4).alias("momentum"),
    )


def time_to_double(latest_views: Column, views_an_hour: Column) -> Column:
    """Seconds until the views have doubled; null if they are few or hardly grow."""
    return F.when((views_an_hour > 10) & (latest_views > 50), F.round(latest_views / views_an_hour * 3600, 1))


def news_value(parts: list[Column]) -> Column:
    return F.round(sum(parts[1:], parts[0]) / len(parts), 4)


def shared_address_candidates(items: DataFrame, stories: DataFrame, item: str, story: str, own: str | None = None) -> DataFrame:
    """item, story: pairs that share a URL, or that share a domain while the item has URLs. Both sides have arrays `urls`
    and `domains`; `own` is the item's story column, which is left out of its candidates.

    Joins go by the shared value, so no pair is made that shares none.
    """
    rest = [own] if own else []
    hits = None
    for column, keep in (("urls", F.lit(True)), ("domains", F.size("urls") > 0)):
        left = items.where(keep).select(item, *rest, F.explode(F.array_distinct(column)).alias("__value"))
        right = stories.select(F.col(story), F.explode(F.array_distinct(column)).alias("__value"))
        pairs = left.join(right, "__value").drop("__value")
        hits = pairs if hits is None else hits.unionByName(pairs)
    if own:
        hits = hits.where(~F.col(own).eqNullSafe(F.col(story)))
    return hits.select(item, story).distinct()


def reassign(members: DataFrame, moves: DataFrame, item: str, story: str, current: str) -> DataFrame:
    """Memberships after moves (item, target): the current one is closed, and a current one of the target is added."""
    m = members.join(moves.select(F.col(item), F.col("target").alias("__t")), item, "left")
    moved = F.col(current) & F.col("__t").isNotNull() & (F.col("__t") != F.col(story))
    m = m.withColumn("__moved", moved)
    old = m.withColumn(current, F.col(current) & ~F.col("__moved")).select(members.columns)
    new = m.where("__moved").withColumn(story, F.col("__t")).select(members.columns)
    return old.unionByName(new)


def double_assignments(members: DataFrame, item: str, current: str) -> DataFrame:
    """item, n: items with more than one current membership."""
    return members.where(F.col(current)).groupBy(item).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
