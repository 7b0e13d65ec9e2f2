"""Intake: exact deduplication, rejection, revisions, snapshots and idempotent upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def blank(*columns: str) -> Column:
    """Whether a row has nothing in any of the columns."""
    return F.length(F.regexp_replace(F.concat_ws("", *columns), r"\s+", "")) == 0


def same_source_outcome(items: DataFrame, source: str, keys: list[str], order: str, to: str = "outcome") -> DataFrame:
    """items with `to`: created, or duplicate_<key> by the first of `keys` that an earlier created row of the same source
    has. Null keys never match; the same key in another source is a confirmation, not a copy.

    The earliest row of each key is found by a partial aggregate, so a key that a third of the rows share costs a row a
    task, and the join back is one that can be split.
    """
    out = items.withColumn(to, F.lit("created"))
    for key in keys:
        first = out.where((F.col(to) == "created") & F.col(key).isNotNull()).groupBy(F.col(source).alias("__s"), F.col(key).alias("__k")).agg(F.min(order).alias("__first"))
        out = out.join(first, F.col(source).eqNullSafe(F.col("__s")) & (F.col(key) == F.col("__k")), "left")
        late = (F.col(to) == "created") & (F.col(order) > F.col("__first"))
        out = out.withColumn(to, F.when(late, F.lit(f"duplicate_{key}")).otherwise(F.col(to))).drop("__s", "__k", "__first")
    return out


def new_rows(incoming: DataFrame, history: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """Incoming rows that no earlier batch has under any of the keys."""
    for key in keys:
        seen = history.where(F.col(key).isNotNull()).select(F.col(source).alias("__s"), F.col(key).alias("__k")).distinct()
        incoming = incoming.join(seen, (F.col(source) == F.col("__s")) & (F.col(key) == F.col("__k")), "left_anti")
    return incoming


def material_change(old: list[Column], new: list[Column]) -> Column:
    """Whether any of the columns differs, null counting as empty."""
    changed = F.lit(False)
    for a, b in zip(old, new):
        changed = changed | (F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit("")))
    return changed


def newer_edit(incoming: Column, existing: Column) -> Column:
    return incoming.isNull() | existing.isNull() | (incoming > existing)


def revisions(versions: DataFrame, item: str, order: str, body: str) -> DataFrame:
    """One row for each material change: item, revision_number and the text before it."""
    w = W.partitionBy(item).orderBy(order)
    changed = versions.withColumn("previous", F.lag(body).over(w)).withColumn("__n", F.row_number().over(w))
    changed = changed.where((F.col("__n") > 1) & material_change([F.col("previous")], [F.col(body)]))
    return changed.withColumn("revision_number", F.row_number().over(w)).select(item, order, "revision_number", "previous")


def snapshots(items: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows with at least one known metric."""
    return items.where(F.coalesce(*metrics).isNotNull())


def milestone_once(captures: DataFrame, item: str, target: str, captured: str) -> DataFrame:
    """The first capture of each item and milestone; later ones of the same are conflicts and go."""
    rest = [c for c in captures.columns if c not in (item, target)]
    return captures.groupBy(item, target).agg(F.min_by(F.struct(*rest), captured).alias("r")).select(item, target, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """incoming replaces current by key; rows under other keys stay."""
    return current.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def bounded_payload(payload: Column, keep: list[str], most: int = 65_536) -> Column:
    """A JSON text, or, beyond `most` bytes, one of its essential keys marked as truncated."""
    few = F.struct(F.lit(True).alias("_truncated"), *[F.get_json_object(payload, f"$.{k}").alias(k) for k in keep])
    return F.when(F.octet_length(payload) > most, F.to_json(few)).otherwise(payload)


def collection_name(base: str, provider: Column, model: Column, version: Column, dimension: Column) -> Column:
    """A name for the vectors of one embedding: a readable part of the model's name, the dimension, and a digest of all four."""
    digest = F.sha2(F.concat_ws("|", provider, model, version, dimension.cast("string")), 256)
    slug = F.regexp_replace(F.lower(F.element_at(F.split(model, "/"), -1)), r"[^\p{L}\p{N}]+", "-")
    slug = F.coalesce(F.nullif(F.substring(F.regexp_replace(slug, "^-|-$", ""), 1, 48), F.lit("")), F.lit("model"))
    return F.concat_ws("__", F.lit(base), slug, F.concat(F.lit("d"), dimension.cast("string")), F.substring(digest, 1, 12))
