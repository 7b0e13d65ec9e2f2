"""Fact diff: which facts of a group are new, repeated or changed against those before them.

Changed facts are found by an edit-similarity join on their sorted words. Two texts of lengths m and n whose ratio is at
least r (2 LCS / (m + n), in hundredths) have lengths within r / (2 - r) of each other and share r (m + n) / 2 characters,
counted with repetition. Rare bigrams tell little at 75, where a pair has to share but an eighth of them, so the facts of a
group meet whole: a group is one cell, and a group of many facts is dealt out to blocks by length and hash, with a cell for
each pair of blocks whose lengths can go together. Each text comes to as many cells as its group has such blocks; pairs
exist only inside a task, where numpy drops those whose characters can't do and counts the others' LCS many at a time. A
group of many different facts of like length costs with its square in time, but not in memory or rows. Equal texts of a
group are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import fuzzy
from tidewire.functions import text as T
from tidewire.session import checkpointed

LEAST, SAME = 75, 98  # a changed fact is that like and less than this like a former one
BLOCK = 512  # facts of a group that meet in one cell, with as many others
PAIRS = 1 << 15  # that are compared at a time


def short(least: float = LEAST) -> int:
    """The greatest m + n for which no shared bigram is sure."""
    return max(n for n in range(2, 400) if ceil((n - 2 - 3 * (1 - least / 100) * n) / 2 - 1e-9) < 1)


def sorted_words(norm: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(norm, r"\s+"), lambda w: w != "")), " ")


def _near(cells: pd.DataFrame, least: float, below: float) -> pd.DataFrame:
    """a, b, r of the pairs of whole cells (g, cell, side, id, t): of sides 0 and 1, or of any two of side 2."""
    t = cells["t"].to_numpy()
    codes, n = fuzzy.codes(t)
    kinds = np.zeros((len(t), 32), np.uint16)  # more than one character may fall on one kind, which only raises the bound
    np.add.at(kinds, (np.repeat(np.arange(len(t)), n), np.concatenate([c % 32 for c in codes])), 1)
    ids, side = cells["id"].to_numpy(), cells["side"].to_numpy()
    ends = np.flatnonzero(np.r_[(np.diff(cells["g"]) != 0) | (np.diff(cells["cell"]) != 0), True]) + 1
    share, out, waiting, held = least / (200 - least), [], [], 0

    def compare() -> None:
        x, y = (np.concatenate(z) for z in zip(*waiting))
        both = n[x] + n[y]
        may = 200.0 * np.concatenate([np.minimum(kinds[x[k : k + PAIRS]], kinds[y[k : k + PAIRS]]).sum(1) for k in range(0, len(x), PAIRS)]) >= least * both
        x, y, both = x[may], y[may], both[may]
        r = 200.0 * fuzzy.lcs_many(codes, n, x, y) / both
        good = (r >= least) & (r < below)
        x, y = ids[x[good]], ids[y[good]]
        out.append((np.minimum(x, y), np.maximum(x, y), r[good]))

    for start, end in zip(np.r_[0, ends[:-1]], ends):
        for i in range(start, end):
            if side[i] == 1:
                continue
            j = np.arange(i + 1, end) if side[i] == 2 else np.arange(start, end)[side[start:end] == 1]
            j = j[np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j]) - 1e-9]
            waiting.append((np.full(len(j), i), j))
            held += len(j)
            if held > 8 * PAIRS:
                compare()
                waiting, held = [], 0
    if held:
        compare()
    a, b, r = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pd.DataFrame({"a": a, "b": b, "r": r})


def similar(texts: DataFrame, group: str, id_: str, text: str, least: float = LEAST, below: float = SAME, block: int = BLOCK) -> DataFrame:
    """a, b (a < b), r: the ids of all pairs of different texts of one group with least <= ratio < below. least is above 67.

    Ids are unique numbers. A null or empty text is like none.
    """
    rows = texts.where(F.length(text) > 0).select(F.xxhash64(group).alias("g"), F.col(id_).cast("long").alias("id"), F.col(text).alias("t"))
    # Lengths that can go together are in one or in neighbouring bands.
    band = F.floor(F.log(F.length("t").cast("double")) / log((200 - least) / least) + 1e-9).cast("int")
    of_band = rows.groupBy("g", band.alias("band")).agg(F.count(F.lit(1)).alias("size"))
    sizes = of_band.groupBy("g").agg(F.sum("size").alias("all"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("size") / block).cast("int")))).alias("blocks"))
    rows = rows.join(sizes.hint("merge"), "g").withColumn("band", F.when(F.col("all") > block, band).otherwise(0))
    blocks = lambda x: F.when(F.col("all") > block, F.coalesce(F.element_at("blocks", x), F.lit(0))).when(x == F.lit(0), 1).otherwise(0)
    rows = rows.withColumn("i", F.pmod(F.xxhash64("id"), blocks(F.col("band"))).cast("long"))
    own, numbers = F.col("i"), lambda a, n: F.filter(F.sequence(a, F.greatest(a, n)), lambda x: x < n)
    cell = lambda band, far, i, j, side: F.struct((((band * 2 + far) * (1 << 24) + i) * (1 << 24) + j).cast("long").alias("cell"), F.lit(side).alias("side"))
    here, low = F.col("band").cast("long"), F.col("band").cast("long") - 1
    zero = F.lit(0).cast("long")
    cells = F.flatten(
        F.array(
            F.array(cell(here, 0, own, own, 2)),
            F.transform(numbers(own + 1, blocks(F.col("band")).cast("long")), lambda j: cell(here, 0, own, j, 0)),
            F.transform(numbers(zero, own), lambda i: cell(here, 0, i, own, 1)),
            F.transform(numbers(zero, blocks(F.col("band") + 1).cast("long")), lambda j: cell(here, 1, own, j, 0)),
            F.transform(numbers(zero, blocks(F.col("band") - 1).cast("long")), lambda i: cell(low, 1, i, own, 1)),
        )
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            last = (b["g"] == b["g"].iloc[-1]) & (b["cell"] == b["cell"].iloc[-1])
            rest = b[last]
            if not last.all():
                yield _near(b[~last], least, below)
        if rest is not None and len(rest):
            yield _near(rest, least, below)

    met = rows.select("g", "id", "t", F.inline(cells)).repartition("g", "cell").sortWithinPartitions("g", "cell")
    return met.mapInPandas(run, "a long, b long, r double")


def diff(facts: DataFrame, group: str, at: str, fact: str) -> DataFrame:
    """facts with state: repeated if the group had a fact of the same normal form at an earlier time, else changed if it
    had one with 75 <= ratio of sorted words < 98, else new. Facts of one time don't count against each other.

    A fact that normalises to nothing, or is null, is repeated after another such one and new before. A null time is before all
    others; null groups are one group. Other columns stay as they are.
    """
    norm = F.coalesce(T.fact_key(F.col(fact)), F.lit(""))
    rows = facts.select("*", F.xxhash64(F.col(group)).alias("__g"), norm.alias("__norm"), F.coalesce(F.col(at).cast("double"), F.lit(float("-inf"))).alias("__at"))
    rows = checkpointed(rows.withColumn("__sorted", sorted_words(F.col("__norm"))))
    kinds = checkpointed(rows.groupBy("__g", "__sorted").agg(F.min("__at").alias("first"), F.max("__at").alias("last")).withColumn("id", F.xxhash64("__g", "__sorted")))
    # Hints: the size of a file says little about that of its facts, and none of these sides is small for the driver.
    got = similar(kinds.withColumn("g", F.col("__g")), "g", "id", "__sorted")
    times = kinds.select("id", "first")
    sides = got.select(F.col("a").alias("id"), F.col("b").alias("other")).union(got.select(F.col("b").alias("id"), F.col("a").alias("other")))
    before = sides.join(times.select(F.col("id").alias("other"), "first").hint("merge"), "other").groupBy("id").agg(F.min("first").alias("__before"))
    kinds = kinds.join(before.hint("merge"), "id", "left").select("__g", "__sorted", "__before")
    same = rows.groupBy("__g", "__norm").agg(F.min("__at").alias("__same"))
    out = rows.join(same.hint("merge"), ["__g", "__norm"]).join(kinds.hint("merge"), ["__g", "__sorted"], "left")
    state = F.when(F.col("__same") < F.col("__at"), "repeated").when(F.col("__before") < F.col("__at"), "changed").otherwise("new")
    return out.select(*[F.col(c) for c in facts.columns], state.alias("state"))

