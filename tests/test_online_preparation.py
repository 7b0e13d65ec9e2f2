"""The preparation of items for online stories gives the numbers of its plain forms, and components share calls."""

import numpy as np
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import online
from tidewire.operators import similarity as S


def test_sketches_equal_the_expression(spark):
    rows = spark.createDataFrame([("a b c d e f g h",), ("one",), ("",), (None,), (" ".join(f"w{i}" for i in range(9000)),)], "t string")
    grams = T.shingles(T.tokens(F.col("t")))
    got = rows.select(S.minhash(grams, 8).alias("x"), F.transform(grams, lambda s: F.xxhash64(s)).alias("n")).select("x", S.sketches(8)("n").alias("y")).collect()
    assert all(r.x == r.y for r in got) and [len(r.x) for r in got] == [8, 8, 0, 0, 8]


def test_vectors_count_each_word():
    v = np.zeros(online.DIM)
    for w in "b a a c a".split():
        at, sign = online._slot(w)
        v[at] += sign
    assert online.embedded("b a a c a".split()) == (v / np.linalg.norm(v)).tolist() and online.embedded([]) == [0.0] * online.DIM


def test_components_share_calls(spark, tmp_path, monkeypatch):
    made = []
    apply = type(spark.range(1).groupBy("id")).applyInPandas
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInPandas", lambda g, f, s: made.append(g._df.columns) or apply(g, f, s))
    df = spark.createDataFrame([(i, float(i), f"title {i}", f"text of its own {i * 7919}", "en") for i in range(40)], "id long, at double, title string, text string, lang string")
    items = online.prepared(df, "id", F.col("at"), F.col("title"), F.col("text"), F.col("lang"))
    assert online.place(items, str(tmp_path / "log")).count() == 40 and all("bundle" in c for c in made) and made
