import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import ranks

SHARES = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def groups(seed=1):
    rng = random.Random(seed)
    rows = [("big", rng.choice([rng.random(), rng.gauss(0, 1e6), 7.0, 7.0, 10.0 ** rng.randrange(-300, 300)])) for _ in range(3000)]
    rows += [("one", 5.0), ("two", -1.0), ("two", 4.0), (None, 3.0), (None, 9.0), ("none", None), ("none", float("nan")), ("big", float("inf")), ("big", None)]
    return rows + [("same", 2.5)] * 500 + [("edge", x) for x in (1.7e308, -1.7e308, 0.0, 5e-324, -0.0)] * 40


def plain(values, p):
    values, x = sorted(values), p * (len(values) - 1)
    low, high = values[int(x)], values[-int(-x // 1)] if x % 1 else values[int(x)]
    return low + (x - int(x)) * (high - low)


@pytest.mark.parametrize("few,bins", [(4096, 1024), (3, 64), (1, 2)])
def test_equals_sorting(spark, monkeypatch, few, bins):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "BINS", bins)
    rows = groups() if few > 3 else [(k, v) for k, v in groups() if k != "edge" and (v is None or not 1e7 < abs(v) < float("inf")) and (k != "big" or bins > 2)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: r for r in ranks.percentiles(df, ["k"], F.col("x"), SHARES).collect()}
    of = {}
    for k, v in rows:
        if v is not None and v == v and abs(v) < float("inf"):
            of.setdefault(k, []).append(v)
    assert set(got) == set(of)
    for k, values in of.items():
        assert got[k].n == len(values)
        if k != "edge":
            assert [got[k][n] for n in SHARES] == pytest.approx([plain(values, p) for p in SHARES.values()], rel=1e-12)
        else:
            assert (got[k].p0, got[k].p50, got[k].p100) == (-1.7e308, 0.0, 1.7e308)


def test_no_keys_and_empty_table(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("n"))
    r = ranks.percentiles(df, [], F.col("n"), {"a": 0.3, "b": 0.255}).first()
    assert (r.n, r.a, r.b) == (101, 30.0, 25.5)
    assert ranks.percentiles(df.limit(0), [], F.col("n"), {"a": 0.3}).count() == 0
