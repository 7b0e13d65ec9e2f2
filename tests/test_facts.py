import random

import numpy as np
import pytest

from tidewire.functions import fuzzy
from tidewire.operators.facts import diff, short, similar

SCHEMA = "conv string, at int, fact string, state_of string"


def plain_key(text):
    return " ".join("".join(c if c.isalnum() or c == "_" else " " for c in (text or "")).lower().split())


def plain(rows):
    """All pairs of a group, one by one."""
    out = []
    for g, at, fact, _ in rows:
        key = plain_key(fact)
        before = [plain_key(f) for h, t, f, _ in rows if h == g and (t if t is not None else -1) < (at if at is not None else -1)]
        like = any(75 <= fuzzy.token_sort(key, p) < 98 for p in before if key and p)
        out.append((g, at, fact, "repeated" if key in before else "changed" if like else "new"))
    return sorted(out, key=str)


def facts(seed, n, groups=4):
    rng = random.Random(seed)
    words = "the mayor opened a new bridge on monday after ten years of work costing 12 million in town".split()
    rows = []
    for i in range(n):
        w = rng.sample(words, rng.randrange(1, 12))
        rows.append([f"g{rng.randrange(groups)}", rng.randrange(9), " ".join(w), None])
        if i % 2:
            g, at, text, _ = rng.choice(rows)
            w = text.split()
            w[rng.randrange(len(w))] = rng.choice(words)
            rng.shuffle(w)
            rows.append([g, at + 1, " ".join(w).capitalize() + rng.choice([".", "", "!"]), "x"])
    return [tuple(r) for r in rows]


def test_equals_all_pairs(spark):
    rows = facts(3, 160) + [("g1", None, "The mayor opened a bridge", None), ("g1", 2, None, None), ("g1", 3, "", None), ("g1", 4, "...", None), (None, 1, "ten years of work", None), (None, 2, "ten years of works", None)]
    rows += [("s", t, w, None) for t, w in enumerate(["a", "ab", "abc", "abcd", "abce", "ba", "xyz", "xyza", "aaaa", "aaab", "aabaa", "abcde", "abcdf", "bcd"])]
    df = spark.createDataFrame(rows + rows[:5], SCHEMA).repartition(6)
    got = sorted(((r.conv, r.at, r.fact, r.state) for r in diff(df, "conv", "at", "fact").collect()), key=str)
    want = plain(rows + rows[:5])
    assert got == want and {r[3] for r in want} == {"new", "repeated", "changed"}


@pytest.mark.parametrize("least,below", [(75, 98), (85, 101), (70, 90)])
def test_join_finds_every_pair_and_no_other(spark, least, below):
    rng = random.Random(least)
    texts = sorted({"".join(rng.choice("ab ") for _ in range(rng.randrange(1, 14))) for _ in range(60)} | {"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 60))) for _ in range(20)})
    texts += [t[:k] + c + t[k + 1 :] for t in texts[-20:] for k, c in ((2, "z"), (4, "yy"))]
    rows = [(i, "g", t) for i, t in enumerate(dict.fromkeys(texts))]
    got = {(r.a, r.b): r.r for r in similar(spark.createDataFrame(rows, "id long, g string, t string"), "g", "id", "t", least, below).collect()}
    want = {(i, j): fuzzy.ratio(a, b) for i, _, a in rows for j, _, b in rows if i < j and least <= fuzzy.ratio(a, b) < below}
    assert got == pytest.approx(want) and want


def test_bound_of_short_texts():
    assert short(75) == 8  # of (m + n) / 8 - 1 bigrams the ninth character makes one


def test_empty_table_and_names(spark):
    assert diff(spark.createDataFrame([], SCHEMA), "conv", "at", "fact").count() == 0
    df = spark.createDataFrame([("a", 1, "x y", 5)], "conv string, at int, fact string, first int")
    assert diff(df, "conv", "at", "fact").columns == ["conv", "at", "fact", "first", "state"]
    assert diff(df, "conv", "at", "fact").first().first == 5


def test_blocks_of_a_large_group_meet_once(spark):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("abcd ") for _ in range(rng.choice([2, 3, 9, 14, 16, 25, 40, 70]))) for _ in range(150)} | {"ab" * k for k in range(1, 60, 3)})
    rows = [(i, g, t) for i, (g, t) in enumerate((g, t) for g in ("g", "h") for t in texts[: 200 if g == "g" else 9])]
    got = sorted((r.a, r.b) for r in similar(spark.createDataFrame(rows, "id long, g string, t string").repartition(5), "g", "id", "t", 70, 101, block=6).collect())
    assert got == [(i, j) for i, g, a in rows for j, h, b in rows if g == h and i < j and 70 <= fuzzy.ratio(a, b)] and got


def test_nothing_that_files_hide_is_broadcast(spark, tmp_path):
    """Facts of small files, as their words repeat, were taken for small and went through the driver with all their bigrams."""
    rows = [(f"c{k % 7}", k // 7, "Some words that come again and again " * 40 + str(k), None) for k in range(70)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/f")
    plan = diff(spark.read.parquet(f"{tmp_path}/f"), "conv", "at", "fact")._jdf.queryExecution().toString()
    assert "Broadcast" not in plan


def test_many_subsequences_at_a_time():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc é🙂"[: rng.randint(1, 6)]) for _ in range(rng.choice([1, 2, 63, 64, 65, 128, 130, 300]))) for _ in range(40)]
    pairs = [(i, j) for i in range(40) for j in range(40)]
    codes, n = fuzzy.codes(texts)
    got = fuzzy.lcs_many(codes, n, *map(np.array, zip(*pairs)), most=64)
    assert got.tolist() == [fuzzy.lcs(texts[i], texts[j]) for i, j in pairs]
