"""What the corpus operators share: cutting lineage, guarded broadcast, dense numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.session import checkpointed


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the folder that driver and executors share, without their lineage."""
    return checkpointed(df)


def apart(keep: list[str], outputs: list[str]) -> None:
    """A kept column may not be named like an output: that is an error of the call, told before anything runs."""
    if same := sorted({c.lower() for c in keep} & {c.lower() for c in outputs}):
        raise ValueError(f"kept columns are named like outputs: {', '.join(same)}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it is proven to hold no more than that many rows; else left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dense_rank_offsets(df: DataFrame, group: str, spread: Column, order: list, to: str, buckets: int) -> DataFrame:
    """Number the rows of each group without gaps from 0 in column `to`, without bringing a group into one task.

    `spread` deals a group's rows out to buckets; each (group, bucket) is numbered on its own and starts where the
    buckets before it end. The offsets have one row for each group and bucket, whatever the rows.
    """
    dealt = df.withColumn("__b", F.pmod(spread, F.lit(buckets)).cast("int"))
    ends = dealt.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(F.col(group).alias("__g"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    own = W.partitionBy(group, "__b").orderBy(*order)
    return (
        dealt.withColumn("__r", F.row_number().over(own))
        .join(small(ends, 100_000), (F.col(group) == F.col("__g")) & (F.col("__b") == F.col("__c")))
        .withColumn(to, (F.col("__o") + F.col("__r") - 1).cast("long"))
        .drop("__b", "__r", "__g", "__c", "__o")
    )


def meet(left: DataFrame, right: DataFrame, on: list[str], counted: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Join (inner or left) on the columns `on`, in which no key is left to one task.

    A key with more than a quarter of the rows of an even partition is dealt out: its rows of `left` to as many parts as
    that takes, its rows of `right` to each of them. By that rule there are at most four such keys a partition, so their
    table is broadcast. Keys are counted in `counted` (`left`, if not given), which should be cheap to read again.
    """
    counted = left if counted is None else counted
    most = max(64, counted.count() // (4 * partitions(left.sparkSession)))
    times = counted.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most)
    hot = cut(times.select(*on, F.ceil(F.col("__n") / most).cast("int").alias("__parts")))
    if hot.isEmpty():
        return left.join(right, on, how)
    parts = F.coalesce("__parts", F.lit(1))
    own = left.join(F.broadcast(hot), on, "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("__parts")
    other = right.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return own.join(other, [*on, "__salt"], how).drop("__salt")
