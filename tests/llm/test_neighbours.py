import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.llm.neighbours import nearest
from tidewire.llm.q_neighbours import op4_neighbours
from tidewire.llm.vector_graph import GraphSettings


def exact(rows, k):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == len(rows[0][1])}
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            other = ids != q
            s = x[other] @ np.array(v, float)
            o = np.lexsort((ids[other], -np.round(s, 12)))[:k]
            out[q] = [(int(ids[other][j]), float(s[j])) for j in o]
    return out


def check(got, want, k, least):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(want)
    hit = total = 0
    for q, rs in by.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, len(want[q]) + 1)) and len({r.vec_id for r in rs}) == len(rs)
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(rs, rs[1:]))
        hit += len({r.vec_id for r in rs} & {i for i, _ in want[q]})
        total += len(rs)
    assert hit >= least * total


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    check(op4_neighbours(spark, "/root/testdata/sf0.1").collect(), exact(rows, 20), 20, 0.95)


def test_several_shards_blocks_and_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8)) * rng.uniform(0.5, 2, (700, 1))
    x[300:500] = x[40]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [1.0] * 7 + [None]), (1060, [float("nan")] * 8), (1080, []), (1100, [1.0] * 3), (None, [1.0] * 8), rows[40], rows[60]]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, score string")
    got = nearest(df, F.col("vec_id") % 20 == 0, "vec_id", "embedding", k=5, shard_rows=128, settings=GraphSettings(degree=16, beam=32)).collect()
    check(got, exact(rows, 5), 5, 0.95)


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = nearest(df, F.col("vec_id") % 20 == 0, "vec_id", "embedding").orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0, "vec_id", "embedding").count() == 0


def hard(name):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    if name == "skewed norms":
        x *= rng.lognormal(0, 1, (4000, 1))
    if name == "one outlier":
        x[7] *= 1e5 / np.linalg.norm(x[7])
    if name == "large":
        x *= 1e20
    if name == "mixed":
        x *= 10.0 ** rng.integers(-200, 140, (4000, 1))
    return x


@pytest.mark.parametrize("name", ["isotropic", "skewed norms", "one outlier", "large", "mixed"])
def test_recall_off_the_clustered_table(spark, name):
    x = hard(name)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    got = nearest(df, F.col("vec_id") % 20 == 0, "vec_id", "embedding", shard_rows=2000).collect()
    near = {}
    for r in got:
        near.setdefault(r.query_id, []).append(r)
    hit = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = set(np.argsort(-s)[:20].tolist())
        rs = sorted(near[q], key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 21)) and all(np.isclose(r.score, s[r.vec_id], rtol=1e-9) for r in rs)
        hit += len(want & {r.vec_id for r in rs})
    assert hit >= 0.9 * 200 * 20, hit / 4000


def test_repeats_of_a_query_and_clashing_columns(spark):
    rows = [(20 * i, [1.0, float(i % 2)], "a", 1) for i in range(30)] + [(0, [1.0, 0.0], "a", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ask string, shard int")
    got = nearest(df, F.col("vec_id") % 20 == 0, "vec_id", "embedding", k=3).collect()
    assert len(got) == 30 * 3 and all(r.vec_id != r.query_id for r in got)
    check(got, exact([r[:2] for r in rows[:30]], 3), 3, 1.0)
