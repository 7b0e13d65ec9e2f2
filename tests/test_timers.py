"""Timers against plain Python over the whole stream, whatever the batches, and over a restart."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tidewire.streaming import jobs, timers
from tidewire.streaming.timers import Backoff

SCHEMA = "k string, at timestamp, outcome string, retry_after double"
T0 = datetime(2024, 1, 1)


def feed(spark, path, rows):
    text = "k string, at string, outcome string, retry_after double"
    spark.createDataFrame([(k, None if s is None else str(T0 + timedelta(seconds=s)), o, a) for k, s, o, a in rows], text).selectExpr("k", "cast(at as timestamp) at", "outcome", "retry_after").coalesce(1).write.mode("append").parquet(str(path))


def drain(df, tmp_path, name):
    """Run what is there, with a checkpoint that the next call goes on from."""
    df.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / f"{name}-out")).collect()


def millis(t):
    return round((t.replace(tzinfo=timezone.utc) - T0.replace(tzinfo=timezone.utc)).total_seconds() * 1000)


def plain_retries(rows, until, b):
    out = []
    for k in {r[0] for r in rows if r[0]}:
        due = failures = None
        for _, s, o, a in sorted(((k, s, o, a) for j, s, o, a in rows if j == k and s is not None), key=lambda r: (r[1], str(r[2]))) + [(k, until, None, None)]:
            ms = s * 1000
            if due is not None and due <= ms:
                out.append((k, due, failures, "retry"))
                due = None
            if o == "ok":
                due = failures = None
            elif o in ("limited", "failed"):
                if (failures or 0) >= b.most:
                    out.append((k, ms, failures, "given_up"))
                    due = failures = None
                else:
                    base = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)
                    assert base
                    due, failures = ms + b.millis(k, failures or 0, o, a), (failures or 0) + 1
    return sorted(out)


def test_waits_double_and_stay_within_their_jitter():
    b = Backoff()
    for n in range(4):
        assert 30_000 * 2**n + 2_000 <= b.millis("k", n, "failed", None) < 30_000 * 2**n + 8_000
        assert 60_000 * 2**n + 5_000 <= b.millis("k", n, "limited", None) < 60_000 * 2**n + 15_000
    assert b.millis("k", 2, "limited", 7.5) == 7500 and b.millis("k", 0, "limited", 0.0) > 60_000 and b.millis("k", 0, "failed", 7.5) < 40_000
    assert b.millis("k", 1, "failed", None) == b.millis("k", 1, "failed", None) != b.millis("j", 1, "failed", None)


def test_retries_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), s, rng.choice(["failed", "failed", "limited", "ok", "other", None]), rng.choice([None, None, 9.0])) for s in range(0, 3000, 20)]
    odd = [(None, 5, "failed", None), ("a", None, "failed", None)]
    b = Backoff(most=2)
    folder = tmp_path / "in"
    cut = len(rows) // 3
    feed(spark, folder, rows[:cut][::-1] + odd)
    drain(timers.retries(jobs.stream(spark, str(folder), SCHEMA), "k", "at", "0 seconds", b), tmp_path, "r")
    feed(spark, folder, rows[cut:])
    feed(spark, folder, [("z", 9000, "ok", None)])
    got = drain(timers.retries(jobs.stream(spark, str(folder), SCHEMA), "k", "at", "0 seconds", b), tmp_path, "r")
    have = sorted((r.k, millis(r.due), r.attempt, r.action) for r in got)
    want = plain_retries(rows, 9000, b)
    assert have == want and {w[3] for w in want} == {"retry", "given_up"}


@pytest.mark.parametrize("parts", [1, 4])
def test_fast_path_waits_for_quiet_and_pauses(spark, tmp_path, parts):
    at = [0, 4, 9, 40, 41, 200, 330, 335, 900, 905, 1300]
    rows = [("a", s, None, None) for s in at] + [("b", 7, None, None), ("b", 8, None, None)] + [(None, 3, None, None)]
    rows.sort(key=lambda r: r[1])
    folder, n = tmp_path / "in", -(-len(rows) // parts)
    for i in range(0, len(rows), n):
        feed(spark, folder, rows[i : i + n])
        got = drain(timers.fast_path(jobs.stream(spark, str(folder), SCHEMA), "k", "at", late="0 seconds"), tmp_path, "f")
    feed(spark, folder, [("z", 5000, None, None)])
    got = drain(timers.fast_path(jobs.stream(spark, str(folder), SCHEMA), "k", "at", late="0 seconds"), tmp_path, "f")
    have = sorted((r.k, millis(r.due), r.signals) for r in got if r.k != "z")
    # The bursts that end at 51 and 210 fall into the pause after 19, as does none after 345.
    assert have == [("a", 19_000, 3), ("a", 345_000, 2), ("a", 915_000, 2), ("a", 1_310_000, 1), ("b", 18_000, 2)]
