import random

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import similarity as S
from tidewire.operators.lsh import banded, most_alike

SCHEMA = "id long, sketch array<long>"


def sketches(seed=1, n=120):
    rng = random.Random(seed)
    base = [[rng.randrange(1000) for _ in range(12)] for _ in range(6)]
    rows = []
    for i in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            s[rng.randrange(12)] = rng.randrange(1000)
        rows.append((i, s))
    return rows + [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, []), (None, rows[1][1])]


def alike(a, b):
    return sum(x == y for x, y in zip(a, b)) / len(a)


def plain(rows, bands, width, least):
    first = {}
    for i, s in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        first.setdefault(tuple(s), i)
    items = [(i, s) for s, i in first.items()]
    share = lambda a, b: any(a[k * width : (k + 1) * width] == b[k * width : (k + 1) * width] for k in range(bands))
    return {(min(i, j), max(i, j)): alike(a, b) for x, (i, a) in enumerate(items) for j, b in items[:x] if share(a, b) and alike(a, b) >= least}, first


def test_equals_all_pairs_and_split_buckets_lose_none(spark):
    rows = sketches()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want, first = plain(rows, 4, 3, 0.3)
    for full in (256, 5, 1):
        members, pairs = banded(df, "id", "sketch", 4, 3, 0.3, full)
        got = pairs.collect()
        assert len(got) == len(want) and {(r.a, r.b): r.estimate for r in got} == want
    assert {(r.key, r.first) for r in members.collect()} == {(i, first[tuple(s)]) for i, s in rows if i is not None and s}


def test_nearest_equal_a_plain_list_with_copies(spark):
    rows = sketches(3, 60)
    rows += [(300 + i, rows[5][1]) for i in range(9)]
    got = {}
    for r in most_alike(*banded(spark.createDataFrame(rows, SCHEMA), "id", "sketch", 4, 3, 0.3, 8), 4).orderBy("key", "rank").collect():
        got.setdefault(r.key, []).append((r.candidate, r.estimate))
    pairs, first = plain(rows, 4, 3, 0.3)
    of = {i: first[tuple(s)] for i, s in rows if i is not None and s}
    for i in of:
        near = [(-(1.0 if of[i] == of[j] else pairs.get((min(of[i], of[j]), max(of[i], of[j])), 0)), j) for j in of if j != i]
        assert got.get(i, []) == [(j, -e) for e, j in sorted(near) if e][:4]


def test_recall_against_exact_pairs(spark):
    rng = random.Random(7)
    base = [[rng.randrange(10**6) for _ in range(80)] for _ in range(20)]
    rows = [(i, [str(x if rng.random() > 0.12 else rng.randrange(10**6)) for x in rng.choice(base)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    exact = {(r.a, r.b) for r in S.jaccard_pairs(S.token_sets(df, "id", F.col("words")), "id", 0.6).collect()}
    _, pairs = banded(df.select("id", S.minhash(F.col("words"), 64).alias("sketch")), "id", "sketch", 16, 4, 0.4)
    found = {(r.a, r.b) for r in pairs.collect()}
    assert len(exact) > 200 and len(exact & found) >= 0.9 * len(exact)


def test_empty_table(spark):
    members, pairs = banded(spark.createDataFrame([], SCHEMA), "id", "sketch", 4, 3, 0.3)
    assert members.count() == pairs.count() == 0 and most_alike(members, pairs, 3).count() == 0


def test_sketches_are_made_once_and_equal_the_expression(spark, tmp_path):
    """Texts go through the sketch once, however often members and pairs are read; values are those of the expression."""
    texts = ["a b c d e f g h", "one", "", None, " ".join(f"w{i}" for i in range(2000)), "a b c d e f g x", "A b  c\td"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(2)
    got = S.sketched(df, "id", T.shingle_hashes(T.tokens(F.col("t"))), 64).collect()
    want = df.select("id", S.minhash(T.shingles(T.tokens(F.col("t"))), 64).alias("sketch")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    made = spark.sparkContext.accumulator(0)

    def sketch(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = sketches()
    read = spark.createDataFrame(rows, SCHEMA).mapInPandas(sketch, SCHEMA)
    assert most_alike(*banded(read, "id", "sketch", 4, 3, 0.3, 8), 4).count() > 0
    assert made.value <= len(rows)


def test_all_that_share_a_band_meet_in_blocks_of_the_bucket(spark):
    """One bucket of many sketches, dealt out to cells: each pair once, by the first band that it shares."""
    rng = random.Random(5)
    base = [rng.randrange(1000) for _ in range(6)]
    rows = [(i, base + [rng.randrange(3) for _ in range(6)]) for i in range(150)]
    want, _ = plain(rows, 4, 3, 0.6)
    for full in (256, 40):
        got = banded(spark.createDataFrame(rows, SCHEMA), "id", "sketch", 4, 3, 0.6, full)[1].collect()
        assert len(got) == len(want) > 1000 and {(r.a, r.b): r.estimate for r in got} == want
