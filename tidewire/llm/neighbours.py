"""Approximate nearest neighbours over sharded robust-pruned graphs.

Equal vectors become one point that keeps its smallest ids, so copies cost nothing and none is lost from a result. Points
are dealt to shards of a bounded size, by the magnitude of their norms (half octaves, so that one long vector does not
blur all others) and then by their hash; each shard builds its graph in one task. Queries, deduplicated the same way,
search every shard: a task reads its shard's points once and then streams the queries past them. Scores are inner
products of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.llm.common import cut, partitions, small
from tidewire.llm.vector_graph import GraphSettings, build, lift
from tidewire.llm.vector_graph import nearest as nearest_in

QUERY_BATCH = 512


def usable(rows: DataFrame, key: str, vector: str, **more: Column) -> DataFrame:
    """id, v (and other columns) of the rows that take part: those with an id and a vector that is not null, empty, zero, or holds null or
    non-finite components, and that has the commonest length (of equally common ones the smallest). Repeats of a whole
    row count once."""
    v = F.col(vector)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = rows.where(F.col(key).isNotNull() & sound).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"), *[c.alias(n) for n, c in more.items()])
    sizes = ok.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").head()
    return ok.where(F.size("v") == (sizes["n"] if sizes else 0))


def points(ok: DataFrame, k: int) -> DataFrame:
    """v, ids: each distinct vector with its k + 1 smallest ids. Copies are first gathered in small salted groups."""
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    salt = F.pmod(F.xxhash64("id"), F.lit(partitions(ok.sparkSession)))
    some = ok.groupBy("v", salt.alias("s")).agg(least(F.collect_list("id")).alias("ids"))
    return some.groupBy("v").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))


def _with_band(rows: DataFrame) -> DataFrame:
    """rows and band, the half octave of a vector's norm; there are some 4,300 at most, as doubles have 2,100 octaves."""
    top = rows.withColumn("top", F.array_max(F.transform("v", F.abs)))
    rest = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("top")) * (x / F.col("top")))
    return top.withColumn("band", F.floor(2 * F.log2("top") + F.log2(rest)).cast("int")).drop("top")


def index(ok: DataFrame, k: int, shard_rows: int = 8192, settings: GraphSettings = GraphSettings()) -> DataFrame:
    """One row for each distinct vector: shard (from 0 without gaps), place, v, ids, edges (places), start. A shard expects
    `shard_rows` rows at most."""
    distinct = cut(_with_band(points(ok, k)))
    bands = distinct.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("parts"))
    first = F.coalesce(F.sum("parts").over(W.partitionBy().orderBy("band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    bands = F.broadcast(bands.withColumn("first", first))  # one row a half octave
    dealt = distinct.join(bands, "band").select(
        (F.col("first") + F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int").alias("shard"), "v", "ids", F.col("ids")[0].alias("least")
    )

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("least", ignore_index=True)
        x = lift(np.stack(part["v"]))
        edges, start = build(x, settings)
        out = part[["shard", "v", "ids"]].copy()
        out["place"], out["start"] = np.arange(len(part)), start
        out["edges"] = [e[e < len(x)].tolist() for e in edges[:-1]]
        return out[["shard", "place", "v", "ids", "edges", "start"]]

    schema = "shard int, place int, v array<double>, ids array<long>, edges array<int>, start int"
    return cut(dealt.groupBy("shard").applyInPandas(run, schema))


def _graph(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, list]:
    """Vectors, lifted points, edges, start and ids of a shard's rows."""
    own = own.sort_values("place", ignore_index=True)
    x = np.stack(own["v"])
    edges = np.full((len(x) + 1, max(1, own["edges"].map(len).max())), len(x))
    for i, e in enumerate(own["edges"]):
        edges[i, : len(e)] = e
    return x, lift(x), edges, int(own["start"].iloc[0]), own["ids"].tolist()


def nearest(rows: DataFrame, is_query: Column, key: str, vector: str, k: int = 20, shard_rows: int = 8192, settings: GraphSettings = GraphSettings()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query row, its own id left out; ties go
    to the smaller id. Without usable rows the result is empty. Products beyond the range of doubles are infinite."""
    ok = usable(rows, key, vector, asks=is_query)
    graph = index(ok, k, shard_rows, settings)
    shards = graph.agg(F.coalesce(F.max("shard"), F.lit(-1))).head()[0] + 1
    asked = ok.where("asks").select(F.col("id").alias("query_id"), F.xxhash64("v").alias("ask"), "v")
    wanted = cut(asked.groupBy("ask").agg(F.first("v").alias("v")))
    where = F.sequence(F.lit(0), F.lit(shards - 1)) if shards else F.array().cast("array<int>")
    # The points of a shard come before its queries. No number is null, as pandas would make such a column one of doubles.
    own = graph.withColumns({"is_query": F.lit(False), "ask": F.lit(0).cast("long")})
    blank = {"place": F.lit(0), "start": F.lit(0), "ids": F.array().cast("array<long>"), "edges": F.array().cast("array<int>")}
    ask = wanted.withColumns({**blank, "is_query": F.lit(True)}).withColumn("shard", F.explode(where))
    both = own.unionByName(ask).repartition(partitions(rows.sparkSession), "shard").sortWithinPartitions("shard", "is_query")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, graph = [], None
        for b in frames:
            is_point = ~b["is_query"].astype(bool)
            if is_point.any():
                if graph:
                    raise ValueError("points after queries")
                held.append(b[is_point])
            b = b[~is_point]
            if len(b) and graph is None:
                graph = _graph(pd.concat(held))
                held.clear()
            for i in range(0, len(b), QUERY_BATCH):
                part = b.iloc[i : i + QUERY_BATCH]
                x, p, edges, start, ids = graph
                places, scores = nearest_in(x, p, edges, start, np.stack(part["v"]), k + 1, settings)
                out = []
                for a, near, score in zip(part["ask"], places.tolist(), scores.tolist()):
                    found = sorted((-s, int(t)) for j, s in zip(near, score) if j >= 0 for t in ids[j])
                    out += [(a, f, t) for f, t in found[: k + 1]]
                yield pd.DataFrame(out, columns=["ask", "far", "vec_id"])

    some = both.groupBy("shard").applyInPandas(run, "ask long, far double, vec_id long")
    order = F.row_number().over(W.partitionBy("ask").orderBy("far", "vec_id"))
    near = some.withColumn("n", order).where(F.col("n") <= k + 1).groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("far", "vec_id"))).alias("near"))
    hits = asked.select("query_id", "ask").distinct().join(small(cut(near), 50_000), "ask")
    own_out = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    hits = hits.select("query_id", F.posexplode(own_out).alias("pos", "n"))
    return hits.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), (-F.col("n.far")).alias("score"))
