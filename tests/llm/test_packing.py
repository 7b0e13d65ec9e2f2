import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from tidewire.llm.packing import make_plan, pieces, place, reduce
from tidewire.llm.q_packing import byte_bpe_encoder


def fill(plan):
    bins = {}
    for s, _, n, c, first, off in plan.lines:
        for q in range(n):
            for i in range(c):
                bins.setdefault(first + q, []).append((off + i * s, s))
    return bins


def fewest(sizes, cap):
    """Brute force: the least number of sequences, over all ways to deal the pieces out."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= sizes[i]}:
            at = rooms.index(r)
            go(i + 1, [*rooms[:at], r - sizes[i], *rooms[at + 1 :]])
        go(i + 1, [*rooms, cap - sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_plan_holds_every_piece_and_is_near_the_fewest(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 16, 25])
    sizes = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
    hist = {s: sizes.count(s) for s in set(sizes)}
    plan = make_plan(hist, cap)
    bins = fill(plan)
    assert sorted(s for b in bins.values() for _, s in b) == sorted(sizes)
    assert sorted(bins) == list(range(plan.sequences))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == list(itertools.accumulate([0] + [s for _, s in b]))[:-1] and sum(s for _, s in b) <= cap
    assert plan.sequences <= fewest(sizes, cap) + 1


@pytest.mark.parametrize("seed", range(300))
def test_the_reduction_costs_no_sequence(seed):
    """The fixed sequences and the fewest of what is left are the fewest of all, by brute force."""
    rng = random.Random(seed)
    cap = rng.choice([10, 14, 20])
    least = rng.choice([1, 2, cap // 4])
    sizes = [rng.randint(least, rng.choice([cap // 2, cap])) for _ in range(rng.randint(1, 9))]
    left = np.bincount(sizes, minlength=cap + 1)
    fixed = reduce(left, cap)
    rest = [s for s in range(cap + 1) for _ in range(left[s])]
    assert sorted(rest + [s for n, content in fixed for s, c in content for _ in range(n * c)]) == sorted(sizes)
    assert all(sum(s * c for s, c in content) <= cap for _, content in fixed)
    assert sum(n for n, _ in fixed) + fewest(rest, cap) == fewest(sizes, cap)


@pytest.mark.parametrize("hist, cap", [({5: 1, 1: 3}, 10), ({400: 1, 100: 3}, 1024), ({6: 2, 4: 2}, 10), ({10: 3}, 10), ({}, 10)])
def test_whole_plans_of_few_pieces(hist, cap):
    sizes = [s for s, n in hist.items() for _ in range(n)]
    assert make_plan(hist, cap).sequences == fewest(sizes, cap)


@pytest.mark.parametrize("sizes", [(300, 200, 100, 50), (400, 300, 200, 100, 24), (90, 80, 70, 60, 50, 40), (1000, 300, 200, 100, 50)])
def test_few_small_pieces_share_a_sequence(sizes):
    plan = make_plan({s: 1 for s in sizes}, 1024)
    assert plan.sequences == fewest(list(sizes), 1024)
    assert sorted(s for b in fill(plan).values() for _, s in b) == sorted(sizes)


def test_counts_of_any_size():
    plan = make_plan({s: 10**9 + s for s in range(1, 1025)}, 1024)
    total = sum(s * (10**9 + s) for s in range(1, 1025))
    assert plan.sequences <= -(-total // 1024) * 1.001 and len(plan.lines) < 200_000


def test_ids_equal_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    texts += ["", " ", "a  b\n\n c\t\r\n", "<|endoftext|> x", "日本語 ⅷ ½ ²³ ١٢٣", "é ‍    x", "it's WE'LL 'tis", "🙂🙃" * 3, "a <|endoftext|> b", "<|endoftext|>" * 3, " " * 20_000 + "x", "\n" * 1_000_000, " " * 1_000_000, "x \t" * 30_000 + " " * 12_000]
    own = byte_bpe_encoder()
    assert [own(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_table(spark):
    rows = [(i, "w" * (i % 7), "x") for i in range(60)] + [(3, "same", "x")] * 5 + [(90, None, "x"), (91, "y" * 47, "x"), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    cut_up = pieces(df, "text", ["doc_id"], lambda: (lambda t: [ord(c) for c in t]), 2, 10)
    got = place(cut_up, 10, "length", ["doc_id", "piece", "start", "ids_crc32"]).collect()
    assert len(got) == cut_up.count()
    long = sorted((r for r in got if r.doc_id == 91), key=lambda r: r.piece)
    assert [(r.start, r.length) for r in long] == [(0, 8), (8, 10), (18, 10), (28, 10), (38, 10)]
    assert long[-1].ids_crc32 == zlib.crc32(np.array([ord("y")] * 9 + [2], "<u4").tobytes())
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 10
    assert place(cut_up.limit(0), 10, "length", ["doc_id"]).count() == 0
