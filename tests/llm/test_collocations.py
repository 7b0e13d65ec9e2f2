import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidewire.llm.collocations as m
from tidewire.llm.collocations import Settings, collocations, common_words, intervals, joined, score, suffixes, tokens

SCHEMA = "lang string, text string, score int, rank string"


def plain(rows, s):
    """By dictionaries of word tuples."""
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, s.words + 1):
                for i in range(len(w) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        got = []
        for p, a in f.items():
            if len(p) < 2 or a < s.least:
                continue
            sub = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and b >= s.least and 100 * b >= s.cover * a and sub(q) for q, b in f.items()):
                continue
            value, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            got.append((-value, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (value, a, p, left, right) in enumerate(sorted(got)[: s.top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -value))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = "salo mire Tavo kelu nori béda éa 日本 x\x00y z z".split(" ")
    gap = [" ", "  ", "\t", ". ", ", ", "\n", " ! ", "\r\n", ";", "   "]
    out = []
    for i in range(n):
        t = "".join(rng.choice(words) + rng.choice(gap[:1] * 8 + gap) for _ in range(rng.randrange(40)))
        out.append((rng.choice(["aa", "bb", None]), t))
    return out


@pytest.mark.parametrize("s", [Settings(least=3, top=7), Settings(least=2, words=4, cover=30), Settings(least=2, words=2), Settings()])
def test_equals_a_plain_version(spark, s):
    rows = texts(4, 80) + [("aa", None), ("aa", ""), (None, " ,. "), ("cc", "A"), ("aa", "salo mire tavo " * 400), ("dd", "x x x x x x x x x x x x x")]
    df = spark.createDataFrame([(a, b, 1, "r") for a, b in rows + rows[:9]], SCHEMA).repartition(5)
    assert sorted(tuple(r) for r in collocations(df, "lang", "text", s).collect()) == plain(rows + rows[:9], s)


def test_shards_and_steps_do_not_matter(spark, monkeypatch):
    rows = [("aa", "salo mire tavo kelu " * 60), ("aa", "salo mire. tavo mire salo " * 30)]
    numbers = {}
    numbers = m._Numbers()
    whole = tokens(rows[0][1], numbers)
    monkeypatch.setattr(m, "_STEP", 7)
    assert (tokens(rows[0][1], numbers) == whole).all()
    assert len(tokens("a" * 50 + " b", m._Numbers())) == 3  # a word longer than a step stays whole
    monkeypatch.setattr(m, "SHARD_WORDS", 50)
    for words in (2, 3):
        seen = Counter()
        for _, numbers, seq, own in m._shards([{"lang": [a for a, _ in rows], "text": [b for _, b in rows]}], words):
            ids = np.searchsorted(np.sort(np.fromiter(numbers.values(), np.uint64)), seq) + 1
            ids[seq == np.uint64(numbers[m._SEPARATOR])] = 0
            names = {v: k for k, v in numbers.items()}
            for n, at, count in intervals(ids, own, [words]):
                for a, c in zip(at.tolist(), count.tolist()):
                    seen[tuple(names[int(x)].decode() for x in seq[a : a + n])] += c
        want = Counter()
        for _, t in rows:
            for piece in t.split("."):
                w = piece.split()
                want.update(tuple(w[i : i + words]) for i in range(len(w) - words + 1))
        assert seen == want


def test_suffix_array_and_lcp_equal_sorting():
    rng = np.random.default_rng(2)
    for words in (1, 2, 3, 5, 8):
        ids = rng.integers(0, 4, 200)
        ids[-1] = 0
        cut = lambda i: tuple(ids[i : i + words].tolist()[: ids[i : i + words].tolist().index(0)] if 0 in ids[i : i + words] else ids[i : i + words].tolist())
        order = suffixes(ids, words)
        keys = [cut(i) for i in order]
        assert keys == sorted(keys)
        lcp = common_words(ids, order, words)
        for a, b, n in zip(keys, keys[1:], lcp[1:]):
            assert n == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_score_is_exact_beyond_64_bits(spark):
    rows = [(10**12, 10**15 + 1, 10**15 + 7), (3 * 10**13 + 1, 3 * 10**13 + 2, 3 * 10**13 + 1), (7, 7, 7), (10, 30, 10)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in got)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = texts(9, 60)
    df = spark.createDataFrame([(a, b, 1, "r") for a, b in rows], SCHEMA)
    monkeypatch.setattr(m, "_bitmap", lambda grams: b"\xff" * 64)
    assert sorted(tuple(r) for r in collocations(df, "lang", "text", Settings(least=2)).collect()) == plain(rows, Settings(least=2))


def test_equal_keys_of_different_words_are_an_error():
    with pytest.raises(ValueError):
        m._one_each(np.array([1, 1], np.uint64), np.array([b"a", b"b"], object))
    assert joined(np.array([1], np.uint64), np.array([2], np.uint64)) != joined(np.array([2], np.uint64), np.array([1], np.uint64))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert collocations(df, "lang", "text").columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations(df, "lang", "text").count() == 0
