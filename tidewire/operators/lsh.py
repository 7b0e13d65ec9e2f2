"""Candidates by locality-sensitive hashing: sketches that agree in one band at least.

Rows of equal sketches are one class with a membership table, so copies never meet as pairs. Classes meet in the buckets of
their bands. A bucket with more classes than a task should compare is split: its classes are dealt out to blocks by hash,
and each pair of blocks is a cell of its own, so that every pair of the bucket meets in exactly one cell. A cell holds the
sketches, so the estimate decides before anything is given out, and a pair is given out by the first band that it shares.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.session import checkpointed


def _agreeing(x: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray, bands: int, width: int) -> np.ndarray:
    """The share of places in which rows a and b of x agree, 0 where `band` isn't the first band that they share."""
    same = x[a] == x[b]
    held = same[:, : bands * width]
    held = np.pad(held, ((0, 0), (0, bands * width - held.shape[1])), constant_values=True).reshape(len(a), bands, width).all(axis=2)
    return np.where((held.argmax(axis=1) == band) & held.any(axis=1), same.sum(axis=1) / x.shape[1], 0.0)


def banded(rows: DataFrame, key: str, sketch: str, bands: int, width: int, least: float, full: int = 256) -> tuple[DataFrame, DataFrame]:
    """(members, pairs). members: key, first, the least key with the same sketch. pairs: a, b (a < b, both firsts), estimate,
    of different sketches that share a band and have estimate >= least, which is above 0.

    Two sketches of similarity s share a band with probability 1 - (1 - s^width)^bands. Null and empty sketches are left out.
    Keys are unique numbers; a null key is left out.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(sketch).alias("sketch")).where(F.col("key").isNotNull() & (F.size("sketch") > 0))
    # Sketches cost the most by far, and what follows reads them more than once.
    rows = checkpointed(rows.withColumn("mark", F.sha2(F.to_binary(F.array_join(F.col("sketch").cast("array<string>"), ","), F.lit("utf-8")), 256)))
    classes = checkpointed(rows.groupBy("mark").agg(F.min("key").alias("first"), F.min_by("sketch", "key").alias("sketch")))
    members = checkpointed(rows.select("key", "mark").join(classes.select("mark", "first"), "mark").select("key", "first"))
    buckets = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("sketch", b * width + 1, width)))
    dealt = classes.select("first", F.posexplode(buckets).alias("band", "bucket"))
    sizes = dealt.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = checkpointed(dealt.join(sizes, ["band", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / full).cast("int")))
    bundles = max(1, dealt.count() // 4096)  # most buckets are a few classes, which aren't worth a call
    alone, block = F.col("blocks") == 1, F.pmod(F.xxhash64("first", "bucket"), F.col("blocks")).cast("int")
    cells = dealt.withColumn("block", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(
        "first", "band", "bucket", "block", F.least("o", "block").alias("i"), F.greatest("o", "block").alias("j"), alone.alias("small"),
        F.when(alone, F.pmod(F.xxhash64("band", "bucket"), F.lit(bundles))).otherwise(F.xxhash64("band", "bucket")).alias("c"),
    )
    cells = cells.join(classes.select("first", "sketch"), "first")

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        out = [(cell["first"].to_numpy()[:0], cell["first"].to_numpy()[:0], np.zeros(0))]
        size = cell["sketch"].map(len)
        for _, of in cell.groupby(size, sort=False):  # sketches of other sizes are alike in nothing
            of = of.sort_values(["band", "bucket", "block"], kind="stable")
            key, x, band, bucket, block = of["first"].to_numpy(), np.stack(of["sketch"]), of["band"].to_numpy(), of["bucket"].to_numpy(), of["block"].to_numpy()
            across = of["i"].to_numpy() != of["j"].to_numpy()
            ends = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (bucket[1:] != bucket[:-1]), True])
            todo, held = [], 0
            for at, end in zip(ends, ends[1:]):
                if across[at]:
                    mid = at + np.searchsorted(block[at:end], block[at], "right")
                    a, b = np.repeat(np.arange(at, mid), end - mid), np.tile(np.arange(mid, end), mid - at)
                else:
                    a, b = (z + at for z in np.triu_indices(end - at, 1))
                todo.append((a, b))
                held += len(a)
                if held < 1 << 14 and end < len(of):
                    continue
                a, b = (np.concatenate(z) for z in zip(*todo))
                todo, held = [], 0
                for part in range(0, len(a), 1 << 14):
                    p, q = a[part : part + (1 << 14)], b[part : part + (1 << 14)]
                    e = _agreeing(x, p, q, band[p], bands, width)
                    ok = e >= least
                    out.append((key[p[ok]], key[q[ok]], e[ok]))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("a", "b", "estimate"), zip(*out))})

    kind = dict(classes.dtypes)["first"]
    pairs = cells.groupBy("small", "c", "i", "j").applyInPandas(run, f"a {kind}, b {kind}, estimate double")
    return members, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "estimate")


def most_alike(members: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """key, candidate, estimate, rank: for each member the k others of the greatest estimate, of equal ones the least key.

    Copies have estimate 1. Of a class no more than k + 1 members can be among anyone's k, so no more of each are paired.
    """
    by = W.partitionBy("first").orderBy("key")
    offered = members.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1).groupBy("first").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    sides = pairs.select("a", "b", "estimate").union(pairs.select("b", "a", "estimate")).toDF("first", "other", "estimate")
    # The classes before it by (estimate, first) have a candidate each, so none after the first k + 1 has one that counts.
    near = W.partitionBy("first").orderBy(F.desc("estimate"), "other")
    sides = sides.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).drop("n")
    one = members.select("first").distinct()
    sides = sides.union(one.select("first", F.col("first").alias("other"), F.lit(1.0).alias("estimate")))
    order = W.partitionBy("first").orderBy(F.desc("estimate"), "candidate")
    given = sides.join(offered.withColumnRenamed("first", "other"), "other").select("first", "estimate", F.explode("keys").alias("candidate"))
    given = given.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)  # one of them may be the member itself
    given = given.groupBy("first").agg(F.collect_list(F.struct("estimate", "candidate")).alias("given"))
    got = members.join(given, "first").select("key", F.inline("given")).where(F.col("key") != F.col("candidate"))
    got = got.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("estimate"), "candidate"))).where(F.col("rank") <= k)
    return got.select("key", "candidate", "estimate", "rank")
