import hashlib
import random
import re

import pytest

from tidewire.llm import substrings
from tidewire.llm.q_substrings import op2_substrings
from tidewire.llm.substrings import dedup

LATE = float("inf")


def brute(rows, k):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = [LATE if i is None else i for i, _ in rows]
    least = {}
    for i, w in zip(ids, split):
        for j in range(len(w) - k + 1):
            e = tuple(w[j : j + k])
            least[e] = min(least.get(e, LATE), i)
    out = []
    for i, w in zip(ids, split):
        gone = set()
        for j in range(len(w) - k + 1):
            if least[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def compare(spark, rows, k):
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, kept string").repartition(5)
    got = dedup(df, "doc_id", "text", ["doc_id"], k).collect()
    assert len(got) == len(rows)
    key = lambda r: (LATE if r[0] is None else r[0], *r[1:])
    want = sorted([(i, *b) for (i, _), b in zip(rows, brute(rows, k))], key=key)
    assert sorted([(r.doc_id, r.words, r.removed, r.kept) for r in got], key=key) == want
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in got:
        for s in r.spans:  # source coordinates hold the same words
            here = [w[s.start : s.start + s.length] for w in text[r.doc_id]]
            there = [w[s.source_start : s.source_start + s.length] for w in text[s.source]]
            assert any(h in there for h in here)
    return got


def test_defined_cases(spark):
    a = "a b c d e f g h"
    rows = [(1, a), (2, "x " + a + " y"), (3, "A b c d e"), (4, None), (5, ""), (6, "a b c"), (7, "a b c d a b c d"), (7, a), (None, a), (None, "q r s t u"), (9, "q r s t u"), (2, "x " + a + " y"), (8, " a b c d e f")]
    compare(spark, rows, 4)
    assert dedup(spark.createDataFrame(rows, "doc_id long, text string").limit(0), "doc_id", "text", ["doc_id"], 4).count() == 0


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [40, 1_500_000])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(substrings, "BLOCK_WINDOWS", block)
    rng = random.Random(seed)
    pieces = [[rng.choice("abcdef") for _ in range(rng.randint(3, 12))] for _ in range(12)]
    rows = [(rng.randrange(80), " ".join(x for _ in range(rng.randint(0, 6)) for x in rng.choice(pieces))) for _ in range(120)]
    compare(spark, rows, 5)


def test_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, g, t) in zip(rows, brute(rows, 13))}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op2_substrings(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and sum(g for _, g, _ in want.values()) > 0
