"""Structured Streaming jobs: intake with an idempotent sink, rolling arrivals, and the keyed state of a story."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewire.operators.intake import new_rows
from tidewire.session import small


def stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def intake_query(items: DataFrame, target: str, checkpoint: str, source: str, keys: list[str], order: str):
    """Appends rows that the target has under none of the keys; one row of each key and source a batch.

    A batch is a folder of the target that is written as a whole, so one that is written again, or was left half written,
    is replaced and adds nothing; the offsets advance after that. Of the target only the key columns are read, and only
    the keys that the batch has too go on from there.
    """
    spark, schema = items.sparkSession, items.schema
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]  # batches are numbered anew with each checkpoint folder
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{target}/run=none/batch=0")  # the first batch finds a table
    stored_as = StructType([*schema.fields, StructField("run", StringType()), StructField("batch", LongType())])

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        stored = spark.read.schema(stored_as).parquet(target).where((F.col("run") != run) | (F.col("batch") != n))
        known = []
        for key in keys:
            asked = small(batch.select(source, key).where(F.col(key).isNotNull()).distinct(), 1_000_000)
            known.append(stored.select(source, key).join(asked, [source, key], "left_semi").distinct())
        fresh = batch
        for key, seen in zip(keys, known):
            fresh = new_rows(fresh, seen, source, [key])
            kept = fresh.where(F.col(key).isNotNull()).groupBy(source, key).agg(F.min_by(F.struct(*fresh.columns), order).alias("r")).select("r.*")
            fresh = kept.unionByName(fresh.where(F.col(key).isNull()))
        fresh.write.mode("overwrite").parquet(f"{target}/run={run}/batch={n}")
        batch.unpersist()

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(events: DataFrame, at: str, keys: list[str], width: str = "15 minutes", slide: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts in sliding windows; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width, slide), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def once(rows: DataFrame, at: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Append-only snapshots, each key once within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def preferences(events: DataFrame, key: str, at: str, value: str, alpha: float = 0.15) -> DataFrame:
    """key, n, preference: an exponentially weighted mean that each batch carries on, in order of time within the batch;
    null values are left out."""

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.5)
        for x in pd.concat(list(batches)).dropna(subset=[value]).sort_values(at, kind="stable")[value]:
            n, mean = n + 1, (1 - alpha) * mean + alpha * float(x)
        state.update((n, mean))
        yield pd.DataFrame({key: [k[0]], "n": [n], "preference": [round(mean, 6)]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, n long, preference double", "n long, mean double", "update", GroupStateTimeout.NoTimeout)


def debounced(events: DataFrame, key: str, at: str, quiet: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """key, start, last, n: one row for each burst of a key's events, once it has been quiet for that long."""
    burst = events.withWatermark(at, late).groupBy(F.session_window(at, quiet).alias("w"), key)
    return burst.agg(F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "last", "n")


def states(events: DataFrame, key: str, at: str, wanted: str, allowed: dict[str, list[str]], first: str) -> DataFrame:
    """key, state, since, refused: the state of each key after a batch, in order of time (then of name) within the batch.

    A change that the present state does not allow is counted as refused; a null wish or time is left out.
    """

    def follow(k: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        now, since, refused = kept.get if kept.exists else (first, None, 0)
        rows = pd.concat(list(batches)).dropna(subset=[wanted, at]).sort_values([at, wanted], kind="stable")
        for when, to in zip(rows[at], rows[wanted]):
            if to in allowed.get(now, ()):
                now, since = to, when.isoformat()
            elif to != now:
                refused += 1
        kept.update((now, since, refused))
        yield pd.DataFrame({key: [k[0]], "state": [now], "since": [since], "refused": [refused]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(
        follow, f"{key} {kind}, state string, since string, refused long", "state string, since string, refused long", "update", GroupStateTimeout.NoTimeout
    )
