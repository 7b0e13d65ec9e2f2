"""Streams that act when time has passed: retries of failed fetches, and the fast path with its pause.

State and timers live in the state store, so a query that is started again goes on where it was. Keys are dealt into BUCKETS
by their hash; a bucket is a group of the stream with one timer, for the first that is pending in it, and Python is called
once a bucket and batch, not once a key. Rows of a key are taken in order of event time, and what would have fallen due
between two of them happens first; so results don't depend on how rows are dealt into batches, as long as none is later than
the watermark allows. What is due after the last row happens once the watermark has passed it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOMES = ("failed", "limited", "ok")  # by name, as rows of one time go
BUCKETS = 1024  # a checkpoint holds for the number that it was begun with
CHUNK = 10_000  # rows of a frame that goes out


@dataclass(frozen=True)
class Backoff:
    """Seconds to wait after the n-th failure in a row (from 0): base * 2^n and a jitter, which the key and n decide."""

    limited: int = 60
    limited_jitter: tuple[int, int] = (5, 15)
    failed: int = 30
    failed_jitter: tuple[int, int] = (2, 8)
    most: int = 3  # retries in a row

    def millis(self, key: str, n: int, outcome: str, retry_after: float | None) -> int:
        if outcome == "limited" and retry_after is not None and retry_after > 0:
            return int(retry_after * 1000)
        base, (low, high) = (self.limited, self.limited_jitter) if outcome == "limited" else (self.failed, self.failed_jitter)
        share = int.from_bytes(hashlib.sha256(f"{key}:{n}".encode("utf-8", "surrogatepass")).digest()[:4], "big") / (1 << 32)
        return int((base * 2**n + low + (high - low) * share) * 1000)


class _Timed:
    """One pending moment a key, at most; `row` and `due` say what happens. A key's state is a tuple of longs, the pending moment
    first; what is kept of a bucket is its keys that have one, and a list for each place of the tuple."""

    fields: tuple[str, ...]
    reads: tuple[str, ...]  # of a row, beside key and millis
    order: tuple[str, ...]

    def step(self, bucket: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        empty, out, now = (None,) * len(self.fields), [], kept.getCurrentWatermarkMs()
        states = {k: tuple(state) for k, *state in zip(*kept.get)} if kept.exists else {}
        for key, millis, *r in () if kept.hasTimedOut else self._rows(frames):
            state = states.get(key, empty)
            while state[0] is not None and state[0] <= millis:
                state = self.due(key, state, out)
            states[key] = self.row(key, state, (millis, *r), out)
            if len(out) >= CHUNK:
                yield self.frame(out)
                out = []
        for key, state in states.items():
            while state[0] is not None and state[0] <= now:
                state = self.due(key, state, out)
            states[key] = state
            if len(out) >= CHUNK:
                yield self.frame(out)
                out = []
        self._keep(kept, {k: state for k, state in states.items() if state != empty})
        if out:
            yield self.frame(out)

    def _rows(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        rows = pd.concat([f[["key", "millis", *self.reads]] for f in frames])
        return rows.sort_values(list(self.order), kind="stable").itertuples(index=False, name=None)

    def _keep(self, kept: GroupState, states: dict) -> None:
        if states:
            kept.update((list(states), *map(list, zip(*states.values()))))
            first = min((state[0] for state in states.values() if state[0] is not None), default=None)
            if first is not None:
                kept.setTimeoutTimestamp(max(first - 1, 1))  # the call comes once the watermark is above that
        elif kept.exists:
            kept.remove()


class _Retries(_Timed):
    fields, reads, order = ("due", "failures"), ("outcome", "retry_after"), ("millis", "outcome")

    def __init__(self, backoff: Backoff) -> None:
        self.backoff = backoff

    def row(self, key, state, r, out) -> tuple:
        failures, (millis, number, after) = state[1] or 0, r
        if number == len(OUTCOMES):
            return state
        if OUTCOMES[number] == "ok":
            return None, None
        if failures >= self.backoff.most:
            out.append((key, millis, failures, "given_up"))
            return None, None
        wait = self.backoff.millis(str(key), failures, OUTCOMES[number], None if pd.isna(after) else after)
        return millis + wait, failures + 1

    def due(self, key, state, out) -> tuple:
        out.append((key, state[0], state[1], "retry"))
        return None, state[1]

    def frame(self, out) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([r[0] for r in out], dtype=object), "millis": pd.Series([r[1] for r in out], dtype="int64"), "attempt": pd.Series([r[2] for r in out], dtype="int64"), "action": pd.Series([r[3] for r in out], dtype=object)})


class _FastPath(_Timed):
    fields, reads, order = ("due", "signals", "last"), (), ("millis",)

    def __init__(self, quiet: int, pause: int) -> None:
        self.quiet, self.pause = quiet, pause

    def row(self, key, state, r, out) -> tuple:
        return r[0] + self.quiet, (state[1] or 0) + 1, state[2]

    def due(self, key, state, out) -> tuple:
        at, signals, last = state
        if last is not None and at - last < self.pause:
            return None, None, last
        out.append((key, at, signals))
        return None, None, at

    def frame(self, out) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([r[0] for r in out], dtype=object), "millis": pd.Series([r[1] for r in out], dtype="int64"), "signals": pd.Series([r[2] for r in out], dtype="int64")})


def _run(events: DataFrame, key: str, processor: _Timed, late: str, out: str) -> DataFrame:
    """events have columns key, at and what the processor reads."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.withWatermark("at", late).withColumn("millis", F.unix_millis("at")).where(F.col("key").isNotNull() & F.col("at").isNotNull())
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    kind = dict(events.dtypes)["key"]
    kept = ", ".join([f"key array<{kind}>", *(f"{f} array<long>" for f in processor.fields)])
    got = rows.groupBy("bucket").applyInPandasWithState(processor.step, f"key {kind}, millis long, {out}", kept, "append", GroupStateTimeout.EventTimeTimeout)
    return got.select(F.col("key").alias(key), F.timestamp_millis("millis").alias("due"), *[F.col(c) for c in got.columns[2:]])


def _number(outcome: str) -> Column:
    """Place in OUTCOMES, or the number after the last."""
    text = F.col(outcome).cast("string")
    return F.coalesce(*[F.when(text == o, F.lit(i)) for i, o in enumerate(OUTCOMES)], F.lit(len(OUTCOMES)))


def retries(outcomes: DataFrame, key: str, at: str, late: str = "1 minute", backoff: Backoff = Backoff()) -> DataFrame:
    """key, due, attempt, action: when to fetch again after a failure ("retry"), or that it isn't tried again ("given_up").

    outcomes are fetches with outcome (ok, limited, failed; others are passed over) and retry_after (seconds, or null). After
    the n-th failure in a row the next attempt is due base * 2^n seconds and a jitter later, or after retry_after of a limited
    one; an ok, or giving up after `most` retries, starts anew. A newer failure replaces what is pending. Rows without key or
    time are passed over; of rows of one time, the outcome first by name comes first.
    """
    rows = outcomes.select(F.col(key).alias("key"), F.col(at).alias("at"), _number("outcome").alias("outcome"), F.col("retry_after").cast("double").alias("retry_after"))
    return _run(rows, key, _Retries(backoff), late, "attempt long, action string")


def fast_path(signals: DataFrame, key: str, at: str, quiet: int = 10, pause: int = 300, late: str = "1 minute") -> DataFrame:
    """key, due, signals: one row for each burst of a key's signals, once it has been quiet for `quiet` seconds, with the
    number of signals. For `pause` seconds after such a row, bursts that end are dropped. Rows without key or time are passed over."""
    rows = signals.select(F.col(key).alias("key"), F.col(at).alias("at"))
    return _run(rows, key, _FastPath(quiet * 1000, pause * 1000), late, "signals long")
