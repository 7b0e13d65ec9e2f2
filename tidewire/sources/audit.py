"""An audit log as a sink with commits: what a run writes is seen wholly or not at all, and once however often it is run.

Tasks write files of their own; the commit writes one small file that names them, an abort deletes them. Readers take the
files of each run's first commit, so files of lost tasks, of attempts that failed and of runs told again are never read.
Counters are observed on the rows as they pass by and become the run's row, without a second pass over them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewire.functions.urls import redact_text
from tidewire.sources.history import filesystem

COMMIT = "run string, attempt string, at long, file string, n long"


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    n: int


class AuditWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.run = schema, options["path"], options["run"]
        self.attempt = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = filesystem(self.path)
        file, out, n = f"{uuid.uuid4().hex}.parquet", None, 0
        shape = to_arrow_schema(self.schema)
        folder = f"{root}/rows/attempt={self.attempt}"
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    files.create_dir(folder, recursive=True)
                    out = pq.ParquetWriter(f"{folder}/{file}", shape, filesystem=files, coerce_timestamps="us")
                out.write_table(pa.Table.from_batches([batch]).cast(shape))
                n += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(file if n else None, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = filesystem(self.path)
        at = time.time_ns()
        rows = [{"run": self.run, "attempt": self.attempt, "at": at, "file": m.file, "n": m.n} for m in messages if m and m.file]
        rows = rows or [{"run": self.run, "attempt": self.attempt, "at": at, "file": None, "n": 0}]
        for folder in ("drafts", "commits"):
            files.create_dir(f"{root}/{folder}", recursive=True)
        with files.open_output_stream(f"{root}/drafts/{self.attempt}") as out:
            out.write("\n".join(map(json.dumps, rows)).encode())
        files.move(f"{root}/drafts/{self.attempt}", f"{root}/commits/{self.attempt}.json")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = filesystem(self.path)
        folder = f"{root}/rows/attempt={self.attempt}"
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class AuditLog(DataSource):
    """`df.write.format("audit_log").mode("append")`, with the options path and run."""

    @classmethod
    def name(cls) -> str:
        return "audit_log"

    def writer(self, schema: StructType, overwrite: bool) -> AuditWriter:
        if overwrite:
            raise ValueError("an audit log is only appended to")
        return AuditWriter(schema, dict(self.options))


def events_of(rows: DataFrame, kind: Column, at: Column, told: Column, ids: dict[str, Column]) -> DataFrame:
    """event, at, message, and an id column for each of `ids`: events whose free text has its secrets masked."""
    return rows.select(kind.cast("string").alias("event"), at.alias("at"), redact_text(told).alias("message"), *[c.alias(n) for n, c in ids.items()])


def record(events: DataFrame, path: str, run: str, counters: dict[str, Column]) -> dict:
    """Write the events of a run, and then the run's own row with its status and what was counted on the way.

    A run that fails has a row with status "failed", without counters, and no events, and its error goes on to the caller;
    it may be recorded anew. Once a run has succeeded, recording it again changes nothing that readers see."""
    spark = events.sparkSession
    spark.dataSource.register(AuditLog)
    seen = Observation(f"run-{uuid.uuid4().hex}")
    names = sorted(counters)

    def close(status: str, values: dict) -> dict:
        shape = ", ".join(["name string, status string", *(f"`{n}` double" for n in names)])
        row = (run, status, *(None if values.get(n) is None else float(values[n]) for n in names))
        spark.createDataFrame([row], shape).coalesce(1).write.format("audit_log").option("path", f"{path}/runs").option("run", f"{run}:{status}").mode("append").save()
        return {"run": run, "status": status, **values}

    try:
        watched = events.observe(seen, *[counters[n].alias(n) for n in names]) if names else events
        watched.write.format("audit_log").option("path", f"{path}/events").option("run", run).mode("append").save()
    except Exception:
        close("failed", {})
        raise
    return close("success", dict(seen.get) if names else {})


def recorded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """run and the columns of what was committed under a path, each run in its first commit (of equal times, the attempt
    that is first in alphabetical order)."""
    commits = spark.read.schema(COMMIT).json(f"{path}/commits")
    first = commits.groupBy("run").agg(F.min(F.struct("at", "attempt")).alias("f")).select("run", "f.attempt")
    named = commits.join(first, ["run", "attempt"]).where(F.col("file").isNotNull()).select("run", "file")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{path}/rows")
    names = rows.columns
    return rows.withColumn("__file", F.col("_metadata.file_name")).join(named, F.col("__file") == F.col("file")).select("run", *names)


def runs(spark: SparkSession, path: str, counters: list[str]) -> DataFrame:
    """run, status and counters: one row a run, that of its success if it has one."""
    names = sorted(counters)
    told = recorded(spark, f"{path}/runs", ", ".join(["name string, status string", *(f"`{n}` double" for n in names)]))
    last = told.groupBy("name").agg(F.max_by(F.struct("status", *names), F.col("status") == "success").alias("r"))
    return last.select(F.col("name").alias("run"), "r.*")
