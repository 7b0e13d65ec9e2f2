"""Keys of one bucket share calls and a timer, and yet each goes its own way."""

import random

import pytest
from test_timers import SCHEMA, drain, feed, millis, plain_retries

from tidewire.streaming import jobs, timers
from tidewire.streaming.timers import Backoff


def drained(df, tmp_path):
    """The rows that a new run gives, and the most rows that its state held."""
    run = df.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out")).collect(), max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress)


def test_state_of_signals_grows_with_buckets_and_not_with_keys(spark, tmp_path):
    rows = [(f"k{i}", i % 7, None, None) for i in range(3000)]
    feed(spark, tmp_path / "in", [*rows, ("z", 5000, None, None)])
    got, held = drained(timers.fast_path(jobs.stream(spark, str(tmp_path / "in"), SCHEMA), "k", "at", late="0 seconds"), tmp_path)
    assert held <= 1024
    assert sorted((r.k, millis(r.due), r.signals) for r in got) == sorted((k, s * 1000 + 10_000, 1) for k, s, *_ in rows)


def test_state_of_failures_grows_with_buckets_and_not_with_keys(spark, tmp_path):
    rows = [(f"k{i % 1500}", i % 7, "failed", None) for i in range(3000)]
    feed(spark, tmp_path / "in", [*rows, ("z", 5000, "ok", None)])
    got, held = drained(timers.retries(jobs.stream(spark, str(tmp_path / "in"), SCHEMA), "k", "at", "0 seconds"), tmp_path)
    assert held <= 1024
    assert sorted((r.k, millis(r.due), r.attempt, r.action) for r in got) == plain_retries(rows, 5000, Backoff())


@pytest.mark.parametrize("late", ["0 seconds", "40 seconds"])
def test_many_keys_of_few_buckets_over_batches_and_restarts(spark, tmp_path, monkeypatch, late):
    monkeypatch.setattr(timers, "BUCKETS", 3, raising=False)
    monkeypatch.setattr(timers, "CHUNK", 5, raising=False)
    rng = random.Random(9)
    keys = [f"k{i}" for i in range(40)]
    rows = [(rng.choice(keys), s, rng.choice(["failed", "failed", "limited", "ok", "other", None]), rng.choice([None, None, 9.0])) for s in range(0, 6000, 3)]
    b = Backoff(most=2)
    for i in range(0, len(rows), 500):
        feed(spark, tmp_path / "in", rows[i : i + 500][::-1])
        drain(timers.retries(jobs.stream(spark, str(tmp_path / "in"), SCHEMA), "k", "at", late, b), tmp_path, "r")
    feed(spark, tmp_path / "in", [("z", 90000, "ok", None)])
    got = drain(timers.retries(jobs.stream(spark, str(tmp_path / "in"), SCHEMA), "k", "at", late, b), tmp_path, "r")
    assert sorted((r.k, millis(r.due), r.attempt, r.action) for r in got) == plain_retries(rows, 90000, b)


def test_what_is_due_at_the_watermark_happens_and_a_millisecond_before_it_does_not(spark, tmp_path):
    def run():
        got = drain(timers.fast_path(jobs.stream(spark, str(tmp_path / "in"), SCHEMA), "k", "at", late="0 seconds"), tmp_path, "f")
        return [(r.k, millis(r.due), r.signals) for r in got]

    feed(spark, tmp_path / "in", [("a", 0, None, None), ("z", 9.999, None, None)])
    assert run() == []
    feed(spark, tmp_path / "in", [("z", 10, None, None)])
    assert run() == [("a", 10_000, 1)]


@pytest.mark.parametrize("kind, made", [("date", "date'2024-01-01' + n"), ("double", "n / 4d"), ("binary", "cast(cast(n as string) as binary)"), ("boolean", "n = 1"), ("decimal(20,2)", "cast(n as decimal(20,2))")])
def test_keys_of_other_types_are_kept_over_a_restart(spark, tmp_path, monkeypatch, kind, made):
    monkeypatch.setattr(timers, "BUCKETS", 1, raising=False)

    def run(at):
        text = "n int, at string"
        spark.createDataFrame([(n, f"2024-01-01 00:00:{s:02}") for n, s in at], text).selectExpr(f"{made} k", "cast(at as timestamp) at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = drain(timers.fast_path(jobs.stream(spark, str(tmp_path / "in"), f"k {kind}, at timestamp"), "k", "at", late="0 seconds"), tmp_path, "f")
        return sorted((millis(r.due), r.signals) for r in got)

    assert run([(0, 1), (1, 2)]) == []
    assert run([(0, 3), (1, 4)]) == []
    assert run([(1, 40)]) == [(13_000, 2), (14_000, 2)]
