"""pair_fuzzy against plain versions of its ratios, on turns of more than 220 characters."""

import random

import pytest

from tidewire.functions import fuzzy
from tidewire.plans.catalogue import QUERIES


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if c == d else max(row[j], row[j + 1])
    return row[-1]


def ratio(a, b):
    return 200.0 * lcs(a, b) / (len(a) + len(b))


def partial(a, b):
    a, b = sorted((a, b), key=len)
    return max(ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (one and two):
        return 100.0
    one, two = f"{both} {one}".strip(), f"{both} {two}".strip()
    return max(ratio(one, two), *([ratio(both, one), ratio(both, two)] if both else []))


def weighted(a, b):
    words = lambda f: (" ".join(sorted(f(a.split()))), " ".join(sorted(f(b.split()))))
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < 1.5:
        return max(ratio(a, b), 0.95 * ratio(*words(list)), 0.95 * token_set(a, b))
    scale = 0.9 if spread < 8 else 0.6
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * max(partial(*words(list)), partial(*words(set))))


@pytest.mark.parametrize("seed", range(40))
def test_best_window_equals_brute_force(seed):
    rng = random.Random(seed)
    a, b = ("".join(rng.choice("abc 🙂"[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 30))) for _ in range(2))
    assert fuzzy.partial(a, b) == fuzzy.partial(b, a) == partial(a, b)


def test_whole_turns(spark, tmp_path):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    head = say(70)[:230]
    turns = {1: [head + say(20), head + say(20)], 2: [say(70), say(10)], 3: [say(60), say(30) + " " + say(40)], 4: ["", say(60)], 5: [head, head + " more"]}
    rows = [(c, t, "user", text) for c, texts in turns.items() for t, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["pair_fuzzy"](spark, str(tmp_path)).collect()}
    assert set(got) == set(turns) and all(len(turns[c][0]) > 220 for c in (1, 2, 3))
    for c, (a, b) in turns.items():
        want = [round(f(a, b) / 100, 4) if a and b else 0.0 for f in (weighted, token_set, partial)]
        assert [got[c].title, got[c].token_set, got[c].partial] == want
    assert got[1].title < 1 and got[1].partial < 1


def test_many_pairs_at_a_time(monkeypatch):
    rng = random.Random(3)
    words = ["a", "ab", "ba", "abc", "🙂", "cab", "bca"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)) + " zz"
    pairs = [(say(rng.randint(1, 12)), say(rng.randint(1, 12))) for _ in range(60)] + [("a", "a"), (" a", "a b c b a b c b a"), (say(3), say(40))]
    passes, strands = [], fuzzy._strands
    monkeypatch.setattr(fuzzy, "_strands", lambda some: passes.append(len(some)) or strands(some))
    assert fuzzy.all_scores(pairs) == [pytest.approx((weighted(a, b), token_set(a, b), partial(a, b)), abs=1e-9) for a, b in pairs]
    assert len(passes) < len(pairs) and sum(passes) < 3 * len(pairs)  # was four passes a pair, one pair each
    assert fuzzy.all_scores([("", ""), ("a", ""), ("", "b")]) == [(0.0, 0.0, 100.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
