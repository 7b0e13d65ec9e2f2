import itertools
import random
from math import exp

import numpy as np
import pytest

import tidewire.llm.quality as m
from tidewire.llm.quality import EDGES, Settings, assess, fit, lines, marginals, qualities

SCHEMA = "doc_id long, text string, score double, lines string"


def documents(seed=5, n=240):
    rng = random.Random(seed)
    words = "salo mire tavo kelu nori beda".split()
    good = lambda: " ".join(rng.choice(words) + rng.choice(words) for _ in range(rng.randrange(4, 14))).capitalize() + "."
    bad = lambda: " ".join(rng.choice(words) + "$$$" for _ in range(rng.randrange(4, 14)))
    rows, labels = [], []
    for i in range(n):
        y = i % 3 != 0
        text = [good() if y else bad() for _ in range(rng.randrange(1, 9))]
        if not y and len(text) > 3:
            text[0] = good()
        rows.append((i, "\n".join(text), 0.0, "x"))
        labels.append((i, int(y), 0))
    return rows, labels


def model_of(spark, rows, labels, settings=Settings(steps=60)):
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs, fit(docs, "doc_id", "text", spark.createDataFrame(labels, "doc_id long, quality int, text int"), "doc_id", "quality", settings)


def test_held_out_accuracy_and_defined_cases(spark):
    rows, labels = documents()
    odd = [(900, None, 0.0, "x"), (901, "", 0.0, "x"), (902, " \n\t\n", 0.0, "x"), (None, rows[1][1], 0.0, "x"), (903, rows[0][1], 0.0, "x"), (903, rows[0][1], 0.0, "x"), (904, "salo " * 400_000, 0.0, "x")]
    extra = [(5, 1, 0), (7, 0, 0), (None, 1, 0), (11, None, 0), (13, 7, 0)]  # repeated, told both ways, null key, null and other labels
    docs, model = model_of(spark, rows + odd, [x for x in labels if x[0] % 4 != 2] + extra)
    got = assess(docs, model, "text", ["doc_id"]).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    held = [x for x in labels if x[0] % 4 == 2]
    assert sum((by[i].score >= 0.7) == bool(y) for i, y, _ in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(by[i].quality is None and by[i].lines == [] and by[i].score == pytest.approx(2 / 3, abs=0.05) for i in (900, 901, 902))
    assert by[None].score == by[1].score and by[903].score == by[0].score and len(by[904].lines) == 1
    mixed = by[next(i for i, t, _, _ in rows if i % 3 == 0 and t.count("\n") > 4)]
    assert mixed.score < 0.5 and min(mixed.lines[1:]) < 0.5


def test_too_little_to_learn_and_empty_tables(spark):
    rows, labels = documents(n=12)
    for told in ([], [x for x in labels if x[1] == 1]):
        docs, model = model_of(spark, rows, told)
        want = 0.5 if not told else 1.0
        assert all(r.score == pytest.approx(want, abs=1e-3) for r in assess(docs, model, "text", ["doc_id"]).collect())
    docs, model = model_of(spark, rows, labels)
    assert assess(docs.limit(0), model, "text", ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        assess(docs, model, "text", ["doc_id", "score"])


def test_training_is_bounded_and_repeatable(spark):
    rows, labels = documents()
    docs, one = model_of(spark, rows, labels, Settings(documents=20, window=2, steps=20))
    _, two = model_of(spark, rows[::-1], labels[::-1], Settings(documents=20, window=2, steps=20))
    assert (one.weights == two.weights).all() and one.slope == two.slope


def plain_marginals(score, moves):
    n, p, pairs, total = len(score), np.zeros(len(score)), np.zeros((len(score), 2, 2)), 0.0
    for y in itertools.product((0, 1), repeat=n):
        w = exp(sum(s for s, v in zip(score, y) if v) + sum(moves[a][b] for a, b in zip(y, y[1:])))
        total += w
        p += w * np.array(y)
        for t in range(1, n):
            pairs[t, y[t - 1], y[t]] += w
    return p / total, pairs / total


def test_marginals_equal_all_labellings():
    rng = np.random.default_rng(3)
    sizes = [1, 5, 2, 9, 1, 7]
    first, last = m._ends(np.repeat(np.arange(len(sizes)), sizes))
    score, moves = rng.normal(0, 3, sum(sizes)), rng.normal(0, 2, (2, 2))
    p, pair = marginals(score, moves, first, last)
    at = 0
    for n in sizes:
        want, pairs = plain_marginals(score[at : at + n], moves)
        assert np.allclose(p[at : at + n], want) and np.allclose(pair[:, at : at + n].T.reshape(n, 2, 2), pairs)
        at += n
    long = marginals(np.where(np.arange(50_000) % 2, 40.0, -40.0), np.array([[60.0, 0.0], [0.0, 60.0]]), np.arange(50_000) == 0, np.arange(50_000) == 49_999)
    assert np.isfinite(long[0]).all()


def plain_bins(texts):
    out = []
    for i, text in enumerate(texts):
        own = [x.strip() for x in (text or "").split("\n") if x.strip()]
        for x in own:
            chars = [c for c in x if not c.isspace()]
            letters = [c for c in chars if c.isalpha()]
            punct = [c for c in chars if c in ".,;:!?'\"-()’“”–—،؟"]
            words = x.split()
            symbol = lambda c: not (c.isalpha() or c.isdigit() or c in punct)
            f = [
                len(letters) / len(chars),
                sum(c.isupper() for c in letters) / max(1, len(letters)),
                sum(c.isdigit() for c in chars) / len(chars),
                sum(map(symbol, chars)) / len(chars),
                len(punct) / len(chars),
                sum(a == b for a, b in zip(words, words[1:])) / len(words),
                sum(symbol(w[-1]) for w in words) / len(words),
                len(words),
                len(chars) / len(words),
                own.count(x) - 1,
            ]
            out.append((i, [int(np.searchsorted(e, v)) for e, v in zip(EDGES, f)], len(chars)))
    return out


def test_features_equal_plain_loops(monkeypatch):
    texts = ["Salo mire, TAVO!\n\n salo  salo\tsalo \nA$$$ b### 12", None, "", "x", "日本 текст ÉÀ\nx\nx\n x ", "| a | b\n ", "Ab " * 50, "\U0001f642 ok"]
    owner, bins, weight = lines(texts)
    assert list(zip(owner.tolist(), bins.tolist(), weight.tolist())) == plain_bins(texts)
    monkeypatch.setattr(m, "_UNIT", 16)  # units only cut words at their ends
    owner, bins, weight = lines(texts)
    want = plain_bins(texts)
    assert owner.tolist() == [x[0] for x in want] and weight.tolist() == [x[2] for x in want] and bins[:, :5].tolist() == [x[1][:5] for x in want]


def test_quality_is_the_mean_weighted_by_length(spark):
    rows, labels = documents()
    _, model = model_of(spark, rows, labels)
    text = rows[0][1] + "\n" + rows[1][1]
    quality, score, each = qualities([None, text], model)
    _, _, weight = lines([text])
    assert np.isnan(quality[0]) and score[0] == model.blank
    assert quality[1] == pytest.approx((each[1] * weight).sum() / weight.sum())
