"""The history source over restarts, and the audit log with attempts that fail, against what went in."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewire.sources import audit
from tidewire.sources.history import History, HistoryReader

SHAPE = "id long, body string, again boolean"


def export(path, name, ids, body="m"):
    path.mkdir(exist_ok=True)
    pq.write_table(pa.table({"id": pa.array(ids, pa.int64()), "body": [f"{body}{i}" for i in ids]}), path / name, row_group_size=7)


def fetch(spark, tmp_path, **options):
    spark.dataSource.register(History)
    source = spark.readStream.format("history").schema(SHAPE).option("path", str(tmp_path / "in"))
    for k, v in options.items():
        source = source.option(k, v)
    source.load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return sorted((r.id, r.body, r.again) for r in spark.read.schema(SHAPE).parquet(str(tmp_path / "out")).collect())


def test_cursor_look_back_and_restarts(spark, tmp_path):
    export(tmp_path / "in", "a.parquet", [*range(0, 90, 3), None, *range(90, 100)])
    first = fetch(spark, tmp_path, initial=20, lookback=6)
    newest = sorted([*range(0, 90, 3), *range(90, 100)])[-20:]
    assert first == [(i, f"m{i}", False) for i in newest]
    assert fetch(spark, tmp_path, initial=20, lookback=6) == first  # nothing new
    export(tmp_path / "in", "b.parquet", [104, 101, 250])
    want = sorted(first + [(i, f"m{i}", True) for i in range(94, 100)] + [(i, f"m{i}", False) for i in (101, 104, 250)])
    assert fetch(spark, tmp_path, initial=20, lookback=6) == want
    assert fetch(spark, tmp_path, initial=20, lookback=6) == want
    export(tmp_path / "in", "c.parquet", [251])
    assert fetch(spark, tmp_path, initial=20, lookback=0) == sorted(want + [(251, "m251", False)])


def test_a_history_as_it_stood(spark, tmp_path):
    export(tmp_path / "in", "a.parquet", range(10, 60, 2))
    assert [i for i, _, _ in fetch(spark, tmp_path, until=31, lookback=0)] == list(range(10, 31, 2))
    assert [i for i, _, _ in fetch(spark, tmp_path, lookback=0)] == list(range(10, 60, 2))


def test_offsets_fix_what_a_batch_reads(tmp_path):
    export(tmp_path / "in", "a.parquet", range(100))
    from pyspark.sql.types import BooleanType, LongType, StringType, StructType

    shape = StructType().add("id", LongType()).add("body", StringType()).add("again", BooleanType())
    r = HistoryReader(shape, {"path": str(tmp_path / "in"), "lookback": "5"})
    rows = lambda a, b: sorted((x["id"], x["again"]) for p in r.partitions({"last": a}, {"last": b}) for t in r.read(p) for x in t.to_pylist())
    before = rows(40, 60)
    assert before == [(i, i <= 40) for i in range(36, 61)]
    export(tmp_path / "in", "b.parquet", range(100, 150))
    assert rows(40, 60) == before and rows(60, 60) == [] and r.latestOffset() == {"last": 149}
    empty = HistoryReader(shape, {"path": str(tmp_path / "none")})
    assert empty.latestOffset() == empty.initialOffset() and list(empty.partitions({"last": -1}, {"last": -1})) == []


def counters():
    return {"rows": F.count(F.lit(1)), "most": F.max("n")}


def events(spark, n, told="password: hunter22 for x"):
    return audit.events_of(spark.range(n).withColumnRenamed("id", "n").repartition(3), F.lit("ingest"), F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit(told), {"n": F.col("n")})


SEEN = "event string, message string, n long"


def test_runs_are_recorded_once_and_masked(spark, tmp_path):
    path = str(tmp_path / "log")
    assert audit.record(events(spark, 50), path, "r1", counters()) == {"run": "r1", "status": "success", "rows": 50, "most": 49}
    audit.record(events(spark, 50), path, "r1", counters())
    audit.record(events(spark, 0), path, "none", counters())
    audit.record(events(spark, 7), path, "r2", {})
    log = audit.recorded(spark, f"{path}/events", SEEN).collect()
    assert sorted((r.run, r.n) for r in log) == sorted([("r1", i) for i in range(50)] + [("r2", i) for i in range(7)])
    assert all("hunter22" not in r.message and "[REDACTED]" in r.message for r in log)
    told = {r.run: (r.status, r.rows, r.most) for r in audit.runs(spark, path, list(counters())).collect()}
    assert told == {"r1": ("success", 50.0, 49.0), "none": ("success", 0.0, None), "r2": ("success", None, None)}


def test_a_failed_run_leaves_no_events_and_can_be_run_again(spark, tmp_path):
    path = str(tmp_path / "log")
    bad = events(spark, 40).withColumn("n", F.when(F.col("n") == 17, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("n")))
    audit.record(events(spark, 3), path, "before", counters())
    with pytest.raises(Exception, match="lost"):
        audit.record(bad, path, "r", counters())
    assert {r.run for r in audit.recorded(spark, f"{path}/events", SEEN).collect()} == {"before"}
    assert {(r.run, r.status, r.rows) for r in audit.runs(spark, path, list(counters())).collect()} == {("before", "success", 3.0), ("r", "failed", None)}
    audit.record(events(spark, 40), path, "r", counters())
    assert audit.recorded(spark, f"{path}/events", SEEN).where("run = 'r'").count() == 40
    assert {(r.run, r.status, r.rows) for r in audit.runs(spark, path, list(counters())).collect()} == {("before", "success", 3.0), ("r", "success", 40.0)}
    stray = tmp_path / "log/events/rows/attempt=lost"
    stray.mkdir()
    pq.write_table(pa.table({"event": ["x"], "message": ["y"], "n": [1]}), stray / "stray.parquet")
    assert audit.recorded(spark, f"{path}/events", SEEN).count() == 43
    with pytest.raises(Exception, match="appended"):
        events(spark, 1).write.format("audit_log").option("path", path).option("run", "x").mode("overwrite").save()
