"""Kept vectors against plain Python: search, versions, writers that meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import vectors
from tidewire.operators.intake import collection_name
from tidewire.operators.vectors import Collection, Conflict, Identity

ID = Identity("own", "some/Model_x v2", "1", 8)


def made(n, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, 8))
    return {i: (middles[i % 6] + spread * rng.normal(size=8)) * 10.0 ** rng.integers(-3, 3) for i in range(n)}


def frame(spark, rows, payload="p"):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v], payload) for k, v in rows], "id long, v array<double>, payload string")


def plain(rows, queries, k):
    u = lambda v: v / np.linalg.norm(v)
    out = []
    for q, x in queries.items():
        by = sorted((-round(float(np.clip(u(x) @ u(v), -1, 1)), 4), key) for key, v in rows.items())[:k]
        out += [(q, key, -s + 0.0, i + 1) for i, (s, key) in enumerate(by)]
    return sorted(out)


def found(df):
    return sorted((r.query, r.key, r.score + 0.0, r["rank"]) for r in df.collect())


def test_a_collection_is_named_by_its_whole_identity(spark, tmp_path):
    name = spark.range(1).select(collection_name("b", *map(F.lit, ("own", "some/Model_x v2", "1", 8)))).first()[0]
    assert name.startswith("b__model-x-v2__d8__") and len(name.rsplit("__", 1)[1]) == 12
    one, two = Collection(spark, str(tmp_path), ID), Collection(spark, str(tmp_path), Identity("own", "some/Model_x v2", "2", 8))
    assert one.folder != two.folder
    with pytest.raises(ValueError):
        Identity("", "m", "1", 8)
    with pytest.raises(ValueError):
        one.manifest()


@pytest.mark.parametrize("block", [7, 4096])
def test_search_equals_all_pairs_with_hot_cells_and_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = made(300)
    rows |= {1000 + i: np.arange(1.0, 9) for i in range(150)}  # a third of all rows in one place, all tied
    c = Collection(spark, str(tmp_path), ID)
    c.create(frame(spark, rows.items()), "id", "v", F.col("payload"), cells=12)
    queries = {k: v for k, v in rows.items() if k % 25 == 0}
    queries[-5] = np.ones(8)
    ask = frame(spark, queries.items())
    assert found(c.search(ask, "id", "v", 20, probes=1)) == plain(rows, queries, 20)
    assert found(c.search(ask, "id", "v", 20, probes=12, exact=False)) == plain(rows, queries, 20)
    near = {(q, k) for q, k, _, _ in found(c.search(ask, "id", "v", 5, probes=4, exact=False))}
    want = {(q, k) for q, k, _, _ in plain(rows, queries, 5)}
    assert len(near & want) >= 0.9 * len(want)
    assert found(c.search(ask, "id", "v", 20, probes=1, least=0.9)) == [r for r in plain(rows, queries, 20) if r[2] >= 0.9]


def test_changes_come_in_whole_versions(spark, tmp_path):
    rows = made(120)
    c = Collection(spark, str(tmp_path), ID)
    assert c.create(frame(spark, list(rows.items())[:100]), "id", "v", F.col("payload"), cells=5) == 1
    moved = {k: -rows[k] for k in range(0, 40)}
    assert c.upsert(frame(spark, list(moved.items()) + [(k, rows[k]) for k in range(100, 120)], "new"), "id", "v", F.col("payload")) == 2
    assert c.delete(frame(spark, [(k, None) for k in (1, 2, 110, 777)] + [(None, None)]), "id") == 3
    assert c.upsert(frame(spark, [(2, rows[2])], "back"), "id", "v", F.col("payload")) == 4
    now = {**rows, **moved, 2: rows[2]}
    del now[1], now[110]
    state = {r.key: (tuple(r.vector), r.payload) for r in c.rows().collect()}
    assert state == {k: (tuple(v), "back" if k == 2 else "new" if k < 40 or k >= 100 else "p") for k, v in now.items()}
    ask = {k: rows[k] for k in range(0, 120, 10)}
    want = plain(now, ask, 9)
    assert found(c.search(frame(spark, ask.items()), "id", "v", 9, probes=2)) == want
    assert c.rows(1).count() == 100 and {r.key for r in c.rows(3).collect()} == set(now) - {2}
    assert c.compact() == 5 and c.manifest()["changes"] == []
    assert {r.key: (tuple(r.vector), r.payload) for r in c.rows().collect()} == state
    assert found(c.search(frame(spark, ask.items()), "id", "v", 9, probes=2)) == want


def test_writers_that_meet_and_writers_that_fail(spark, tmp_path, monkeypatch):
    rows = made(20)
    c, other = (Collection(spark, str(tmp_path), ID) for _ in range(2))
    c.create(frame(spark, rows.items()), "id", "v", F.col("payload"), cells=2)
    seen = c.manifest()
    assert other.delete(frame(spark, [(3, None)]), "id") == 2
    with pytest.raises(Conflict):  # made from what is no longer the latest
        c.commit({**seen, "version": 2})
    stale, real = [seen], c.manifest
    monkeypatch.setattr(c, "manifest", lambda *a: stale.pop() if len(stale) and not a and c.late else real(*a))
    c.late = False
    placed = c._write(c._in_cells(c._usable(frame(spark, [(99, rows[0])]), "id", "v", F.lit("x")), c._centroids(seen)).withColumn("deleted", F.lit(False)), "change")
    c.late = True
    assert c._append([placed]) == 3 and not stale  # the first attempt was overtaken
    assert {r.key for r in other.rows().collect()} == set(rows) - {3} | {99}
    monkeypatch.setattr(other, "commit", lambda m: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        other.delete(frame(spark, [(4, None)]), "id")
    assert 4 in {r.key for r in c.rows().collect()}  # what was written without a manifest isn't seen


def test_odd_rows_and_empty_collections(spark, tmp_path):
    c = Collection(spark, str(tmp_path), ID)
    odd = [(None, np.ones(8)), (1, None), (2, np.zeros(8)), (3, np.ones(7)), (4, [float("nan")] + [1.0] * 7), (5, [float("inf")] + [1.0] * 7), (6, np.full(8, 1e308)), (7, np.full(8, 1e-308)), (8, np.ones(8)), (8, np.ones(8) * 2)]
    ask = frame(spark, odd)
    assert c.create(frame(spark, []), "id", "v", F.col("payload")) == 1
    assert c.rows().count() == 0 and c.search(ask, "id", "v").count() == 0
    c.upsert(ask, "id", "v", F.col("payload"))
    assert {r.key: r.vector[0] for r in c.rows().collect()} == {6: 1e308, 7: 1e-308, 8: 2.0}
    got = found(c.search(ask, "id", "v", 3, probes=1))
    assert got == [(q, k, 1.0, i + 1) for q in (6, 7, 8) for i, k in enumerate((6, 7, 8))]
    assert c.search(ask.limit(0), "id", "v").count() == 0
    assert c.compact() == 3 and c.rows().count() == 3


def test_a_second_round_with_nothing_to_visit(spark, tmp_path):
    rows = {i: np.eye(8)[i % 2] for i in range(40)}
    c = Collection(spark, str(tmp_path), ID)
    c.create(frame(spark, rows.items()), "id", "v", F.col("payload"), cells=2)
    assert found(c.search(frame(spark, [(0, rows[0])]), "id", "v", 5, probes=1)) == plain(rows, {0: rows[0]}, 5)
