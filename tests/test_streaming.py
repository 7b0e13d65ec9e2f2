"""Streaming jobs over files, one file a batch, against plain Python."""

import pytest

from tidewire.operators.momentum import TRANSITIONS
from tidewire.streaming import jobs

SCHEMA = "id long, at timestamp, k string, v double"


def feed(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, "id long, at string, k string, v double").selectExpr("id", "cast(at as timestamp) at", "k", "v").coalesce(1).write.mode("append").parquet(str(path))
    return jobs.stream(spark, str(path), SCHEMA)


def run(df, mode, name, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name).collect()


def test_intake_replaces_a_batch_and_reads_what_earlier_runs_stored(spark, tmp_path):
    a, b, out = tmp_path / "a", tmp_path / "b", str(tmp_path / "out")
    feed(spark, a, [[(1, None, "x", 1.0), (2, None, "x", 1.0), (3, None, None, 1.0)], [(4, None, "x", 1.0), (5, None, "y", 1.0)]])
    feed(spark, b, [[(6, None, "y", 1.0), (7, None, "z", 1.0)]])
    for src, ck in ((a, "c1"), (b, "c2"), (a, "c3")):
        jobs.intake_query(jobs.stream(spark, str(src), SCHEMA), out, str(tmp_path / ck), "v", ["k"], "id").awaitTermination()
    got = [(r.id, r.k) for r in spark.read.parquet(out).collect()]
    assert sorted(k for _, k in got if k) == ["x", "y", "z"] and {i for i, k in got if k is None} == {3}


def test_preferences_carry_on_and_skip_nulls(spark, tmp_path):
    batches = [[(1, "2024-01-01 00:00:02", "a", 1.0), (2, "2024-01-01 00:00:01", "a", 0.0), (3, "2024-01-01 00:00:01", "b", None)], [(4, "2024-01-01 00:01:00", "a", 0.5)]]
    got = run(jobs.preferences(feed(spark, tmp_path / "in", batches), "k", "at", "v"), "update", "prefs", tmp_path)
    mean = 0.5
    for x in (0.0, 1.0, 0.5):
        mean = 0.85 * mean + 0.15 * x
    last = max((r for r in got if r.k == "a"), key=lambda r: r.n)
    assert (last.n, last.preference) == (3, round(mean, 6)) and [(r.n, r.preference) for r in got if r.k == "b"] == [(0, 0.5)]


def test_states_follow_only_what_is_allowed(spark, tmp_path):
    batches = [
        [(1, "2024-01-01 00:00:01", "rising", 1.0), (2, "2024-01-01 00:00:02", "archived", 1.0), (3, "2024-01-01 00:00:03", None, 1.0)],
        [(4, "2024-01-01 00:01:00", "breaking", 1.0), (5, "2024-01-01 00:01:01", "breaking", 1.0), (6, "2024-01-01 00:02:00", "watching", 2.0)],
    ]
    got = run(jobs.states(feed(spark, tmp_path / "in", batches), "v", "at", "k", TRANSITIONS, "discovered"), "update", "states", tmp_path)
    assert {(r.v, r.state, r.refused) for r in got} >= {(1.0, "breaking", 1), (2.0, "watching", 0)}


@pytest.mark.parametrize("job", ["arrivals", "once", "debounced"])
def test_windowed_jobs(spark, tmp_path, job):
    t = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [[(1, t(0), "a", 1.0), (2, t(5), "a", 1.0), (3, t(30), "a", 1.0), (1, t(0), "a", 1.0)], [(4, "2024-01-01 06:00:00", "b", 1.0)], [(5, "2024-01-01 07:00:00", "b", 1.0)]]
    stream = feed(spark, tmp_path / "in", batches)
    if job == "arrivals":
        got = run(jobs.arrivals(stream, "at", ["k"]), "append", job, tmp_path)
        assert {(str(r.start), r.n) for r in got if r.k == "a"} == {("2023-12-31 23:50:00", 4), ("2023-12-31 23:55:00", 4), ("2024-01-01 00:00:00", 4)}
    elif job == "once":
        got = run(jobs.once(stream, "at", ["id"]), "append", job, tmp_path)
        assert sorted(r.id for r in got) == [1, 2, 3, 4, 5]
    else:
        got = run(jobs.debounced(stream, "k", "at"), "append", job, tmp_path)
        assert {(str(r.start)[11:], r.n) for r in got if r.k == "a"} == {("00:00:00", 3), ("00:00:30", 1)}
