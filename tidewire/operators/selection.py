"""Which rows are due, recent or eligible: predicates as Column expressions, and the newest or oldest few of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSED = ("merged", "archived", "stale")  # states of stories that take no more items


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) / 1e6 - F.unix_micros(earlier) / 1e6


def recent(updated: Column, now: Column, hours: int = 48) -> Column:
    """Whether an update is at most so many hours old; a missing time is never recent."""
    return F.coalesce(updated >= now - F.expr(f"interval {hours} hours"), F.lit(False))


def eligible(status: Column, updated: Column, now: Column, hours: int = 48) -> Column:
    """Whether a story may take further items: open, and updated recently."""
    return recent(updated, now, hours) & ~F.coalesce(status, F.lit("")).isin(*CLOSED)


def source_due(enabled: Column, cooldown_until: Column, last_success: Column, interval_seconds: Column, now: Column) -> Column:
    """Whether a source is to be fetched: enabled, not cooling down, never fetched or its interval has passed."""
    cooling = F.coalesce(cooldown_until > now, F.lit(False))
    waiting = F.coalesce(seconds_between(now, last_success) < interval_seconds, F.lit(False))
    return F.coalesce(enabled, F.lit(False)) & ~cooling & ~waiting


def due(active: Column, at: Column, now: Column) -> Column:
    return F.coalesce(active & (at <= now), F.lit(False))


def first_rows(rows: DataFrame, keep: Column, order: list[Column], most: int) -> DataFrame:
    """The first `most` of the rows kept, in that order: a bounded batch. Each task keeps its own first rows only."""
    return rows.where(keep).orderBy(*order).limit(most)


def vector_state(status: Column, same_identity: Column, dimension: Column, expected: int, stored: Column, live: Column) -> Column:
    """valid, stale (the text has changed since) or skipped, of a member's stored vector."""
    usable = (status == "indexed") & same_identity & (dimension == expected)
    return F.when(~F.coalesce(usable, F.lit(False)), "skipped").when(stored.eqNullSafe(live), "valid").otherwise("stale")


def breakdown_faults(groups: Column, required: tuple[str, ...] = ("news_value", "audience_fit", "momentum")) -> Column:
    """Of a map of groups of numbers: required groups that are missing, and numbers that are not within 0 to 1."""
    missing = F.filter(F.array(*map(F.lit, required)), lambda g: ~F.map_contains_key(groups, g))
    numbers = F.flatten(F.transform(F.map_values(groups), F.map_values))
    bad = F.filter(numbers, lambda x: x.isNotNull() & (F.isnan(x) | (x < 0) | (x > 1)))
    return (F.size(missing) + F.size(bad)).cast("int")


def search(rows: DataFrame, words: str | None, columns: list[str], **among: list) -> DataFrame:
    """rows whose columns are among the given values, and one of whose text columns holds the words, whatever their case."""
    for name, values in among.items():
        rows = rows.where(F.col(name).isin(*values))
    if words:
        low = words.lower()
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(low)), F.lit(False))
        rows = rows.where(hit)
    return rows
