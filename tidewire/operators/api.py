"""Lists, nested documents and edits behind the read and write API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import checkpointed, small


def page(rows: DataFrame, filters: dict, ordering: str, allowed: set[str], key: str, number: int = 1, size: int = 50, skip: int | None = None, cap: int = 200) -> DataFrame:
    """One page. Filters that are None are left out; an ordering that is not allowed falls back to the key, and the key
    breaks ties. The rows are capped before they are paged."""
    for name, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    name = ordering.lstrip("-")
    by = [F.desc(name) if ordering.startswith("-") else F.asc(name)] if name in allowed else []
    start = (number - 1) * size if skip is None else skip
    return rows.orderBy(*by, key).limit(cap).offset(start).limit(size)


def nested(parents: DataFrame, children: DataFrame, key: str, parent: str, order: Column, member: str) -> DataFrame:
    """parents with members: the children of each in order; an empty array for none."""
    got = children.groupBy(F.col(parent).alias("__p")).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(member).alias("m")))).alias("a"))
    out = parents.join(got, F.col(key) == F.col("__p"), "left")
    none = F.array().cast(f"array<{children.schema[member].dataType.simpleString()}>")
    return out.withColumn("members", F.coalesce(F.transform("a", lambda x: x["m"]), none)).drop("__p", "a")


def merge(members: DataFrame, merges: DataFrame, story: str, item: str) -> DataFrame:
    """Members of merged stories move to the target; items that it has already stay as they are."""
    out = members.join(small(merges, 100_000), F.col(story) == F.col("source"), "left")
    return out.select(F.coalesce("target", story).alias(story), item).distinct()


def roots(edges: DataFrame, node: str, up: str) -> DataFrame:
    """node, root: pointer jumping, so a chain of length n takes log2 n joins. A chain that comes back to itself fails."""
    now = edges.where(F.col(node) != F.col(up)).select(F.col(node), F.col(up).alias("root"))
    for _ in range(40):
        over = now.select(F.col(node).alias("__n"), F.col("root").alias("__r"))
        nxt = now.join(over, F.col("root") == F.col("__n"), "left").select(node, F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved"))
        nxt = checkpointed(nxt)
        now = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return now
    raise ValueError("the edges have a cycle")


def diff(facts: DataFrame, group: str, at: str, fact: str) -> DataFrame:
    """facts with state: new, or repeated if the group had it before."""
    first = facts.groupBy(group, fact).agg(F.min(at).alias("__first"))
    return facts.join(first, [group, fact]).withColumn("state", F.when(F.col(at) > F.col("__first"), "repeated").otherwise("new")).drop("__first")
