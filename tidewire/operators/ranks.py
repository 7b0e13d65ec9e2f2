"""Exact percentiles of groups of any size, by rank selection over range histograms.

Each round cuts the intervals that hold a wanted rank into bins of equal width and counts them, a partial aggregate of no
more than BINS rows a task and interval. Only bins that hold a wanted rank go on, narrowed to the values that are in them (two bins at least, so that rounds end);
an interval of a single value is settled, and one of few rows is sorted. No group is brought into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.session import checkpointed, small

BINS, FEW, ROUNDS = 1024, 4096, 400


def percentiles(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """keys, n, and for each name its percentile (linear between ranks), for groups with a value. Null, NaN and infinite
    values are left out; null keys are groups of their own. Names are not among the keys."""
    names = [f"__k{i}" for i in range(len(keys))]
    v = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], value.cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) < double('inf')")
    group = F.xxhash64(*names) if names else F.lit(0).cast("long")
    v = v.withColumn("g", F.struct(group.alias("h"), *names))
    whole = checkpointed(v.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    place = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in shares.items()}
    wanted = F.array_sort(F.array_distinct(F.array(*[f(x).cast("long") for x in place.values() for f in (F.floor, F.ceil)])))
    live = whole.select("g", "lo", "hi", "n", F.lit(0).cast("long").alias("base"), wanted.alias("ranks"))  # ranks from 0 in the group
    values = v.select("g", "v")
    found = None
    for _ in range(ROUNDS):
        live = checkpointed(live)
        done = live.where("lo = hi").select("g", F.explode("ranks").alias("rank"), F.col("lo").alias("v"))
        few = live.where(f"lo < hi and n <= {FEW}")
        # Rows of a group meet its intervals; there are two a percentile at most.
        of = lambda x: values.join(small(x.withColumnRenamed("n", "m"), 100_000), "g").where("v >= lo and v <= hi")
        sorted_ = of(few).withColumn("rank", F.col("base") + F.row_number().over(W.partitionBy("g", "lo").orderBy("v")) - 1)
        sorted_ = sorted_.where(F.array_contains("ranks", F.col("rank"))).select("g", "rank", "v")
        got = done.unionByName(sorted_)
        found = got if found is None else found.unionByName(got)
        open_ = live.where(f"lo < hi and n > {FEW}")
        if open_.isEmpty():
            break
        width = F.col("hi") / 2 - F.col("lo") / 2  # halves don't overflow; the least of them is 0
        at = F.when(width > 0, F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * BINS)).when(F.col("v") > F.col("lo"), BINS).otherwise(0)
        bins = of(open_).groupBy("g", "lo", "base", "ranks", F.least(at, F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("from"), F.max("v").alias("to"))
        before = F.sum("n").over(W.partitionBy("g", "lo").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
        bins = bins.withColumn("base", F.col("base") + F.coalesce(before, F.lit(0)))
        bins = bins.withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("base")) & (r < F.col("base") + F.col("n"))))
        live = bins.where(F.size("ranks") > 0).select("g", F.col("from").alias("lo"), F.col("to").alias("hi"), "n", "base", "ranks")
    else:
        raise ValueError("the bins don't narrow")
    held = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    out = whole.join(held, "g")
    one = lambda x: F.element_at("at", x.cast("long"))
    cols = [(one(F.floor(x)) + (x - F.floor(x)) * (one(F.ceil(x)) - one(F.floor(x)))).alias(name) for name, x in place.items()]
    return out.select(*[F.col(f"g.{n}").alias(k) for k, n in zip(keys, names)], "n", *cols)
