import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm.common import meet
from tidewire.llm.components import components
from tidewire.llm.jaccard import _owned, _owners, classes


def sets(rows, n):
    out = {}
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        out.setdefault(i, []).append(s)
    return out


def brute(rows, n, percent):
    rows = [(i, s) for i, ss in sets(rows, n).items() if i is not None for s in ss]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index = {}
    for at, (i, s) in enumerate(rows):
        for t in s:
            index.setdefault(t, []).append(at)
    seen = set()
    for at in index.values():
        for x in range(len(at)):
            for y in range(x):
                if (at[y], at[x]) in seen:
                    continue
                seen.add((at[y], at[x]))
                (i, a), (j, b) = rows[at[y]], rows[at[x]]
                if 100 * len(a & b) >= percent * len(a | b):
                    lo, hi = sorted((find(i), find(j)))
                    root[hi] = lo
    return {i: find(i) for i in root}


def compare(spark, rows, n=4, percent=85):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string")
    got = classes(df, "doc_id", "text", n, percent).collect()
    want, size = brute(rows, n, percent), sets(rows, n)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component is None
        else:
            assert r.component == want[r.doc_id], r
            assert r.n_tokens in {len(s) for s in size[r.doc_id]}
    return got


def test_small_cases(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (3, base.upper()), (9, base + " end"), (1, "one two"), (8, "one two"), (7, "one  TWO\t"), (2, None), (4, ""), (6, " \n "), (11, "a b c d"), (12, "a b c e"), (None, base), (5, base), (20, "é É x y z"), (21, "é é x y z")]
    compare(spark, rows)


def test_different_texts_under_one_key(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (5, c), (5, ""), (4, c + " end"), (9, a), (9, c), (20, "x y"), (20, None), (30, "p q r s t"), (30, "one two"), (31, "one two")]
    got = {r.doc_id: r.component for r in compare(spark, rows)}
    assert got[3] == got[4] == 1 and got[20] == 20 and got[31] == 30


def test_a_hot_token_is_dealt_out(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base[: 30 + rng.randrange(10)] + [f"v{rng.randrange(40)}" for _ in range(rng.randrange(8))])) for i in range(400)]
    compare(spark, rows)


def test_meet_equals_a_join(spark):
    left = spark.createDataFrame([(0 if i % 2 else i % 50, i) for i in range(2000)], "k int, i int")
    right = spark.createDataFrame([(k, v) for k in range(60) for v in range(2)], "k int, v int")
    want = sorted((i % 50 if i % 2 == 0 else 0, i, v) for i in range(2000) for v in range(2))
    assert sorted((r.k, r.i, r.v) for r in meet(left, right, ["k"]).collect()) == want
    assert meet(left.limit(0), right, ["k"]).count() == 0


def test_shuffled_bytes_do_not_grow_with_the_partitions():
    """A cell's owners cost no more than a byte a token, however many rows its block has."""
    rng = np.random.default_rng(1)
    for rows, tokens in ((5000, 300), (5000, 60000), (1, 10), (300, 0)):
        owner = np.sort(rng.integers(0, rows, tokens))
        raw = _owners(owner, rows)
        assert (_owned(raw) == owner).all() and len(raw) <= 2 + max(1, 2 * (tokens < 200)) * tokens


def test_empty_table(spark):
    assert classes(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_at_all_distances(spark, seed):
    """Copies with few to many edits of long and short texts, chains of links, and passages that many texts share."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(500)}"
    passage = [word() for _ in range(15)]
    rows, i = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 30, 120]))]
        if rng.random() < 0.5:
            base[3:3] = passage
        for _ in range(rng.choice([1, 3, 25])):
            t = list(base)
            for _ in range(int(rng.random() * 0.06 * len(t) + rng.random())):
                t[rng.randrange(len(t))] = word()
            rows.append((i, " ".join(t)))
            i += 1
        step = list(base)
        for _ in range(6):  # a chain: each a little further
            step[rng.randrange(len(step))] = word()
            rows.append((i, " ".join(step)))
            i += 1
    rng.shuffle(rows)
    compare(spark, rows)


def test_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = compare(spark, rows)
    assert len({r.component for r in got}) < len(rows)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
