import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import online
from tidewire.operators.online import Rules, embedded, fold, match, place, prepared, slices, step

SCHEMA = "id long, at double, title string, text string, lang string, story string"


def rows_of(seed, n=70):
    rng = random.Random(seed)
    words = [a + b for a in "salo mire tavo kelu nori beda sun".split() for b in "an er os it el".split()]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(12, 30))) for _ in range(7)]
    out = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(words + ["12", "450"])
        text = " ".join(w) + rng.choice(["", "", " see https://a.example/x", " at https://b.example/y?z=1"])
        out.append((i * 9 % n, float(i // 3 * 1800), " ".join(w[:6]), text, rng.choice(["en", "en", "fr", None]), "s"))
    return out + [(900, None, "late", base[0], "en", "s"), (901, 5.0, None, None, "en", "s"), (902, 9.0, "", "", None, "s"), (None, 1.0, "x", base[1], "en", "s"), (903, 9.0, "one", "one", None, "s"), (904, 9.0, "one", "one", "", "s")]


def items_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return prepared(df, "id", F.col("at"), F.col("title"), F.col("text"), F.col("lang"))


def sequence(items, rules):
    """All items in one fold, one after the other."""
    got = [{k: list(v) if isinstance(v, list) else v for k, v in r.asDict().items()} for r in items.collect()]
    return sorted((g["item"], g["story"], g["decision"], g["score"]) for g in fold(got, {}, rules)[0])


def result(df):
    return sorted((r.item, r.story, r.decision, r.score) for r in df.collect())


LOOSE = online.Thresholds(high=0.6, low=0.45)


@pytest.mark.parametrize("rules", [Rules(LOOSE), Rules(LOOSE, candidates=2, members=2)])
def test_steps_and_components_equal_one_sequence(spark, tmp_path, rules):
    rows = rows_of(2)
    items = items_of(spark, rows + rows[:4]).persist()
    want = sequence(items, rules)
    assert {w[2] for w in want} == {"match", "ambiguous", "new_story"} and len(want) == 73
    assert result(place(items, str(tmp_path / "a"), rows=25, rules=rules)) == want
    if rules == Rules(LOOSE):
        assert result(place(items, str(tmp_path / "b"), rows=1000, rules=rules)) == want
        # A step that is run again gives the same; items that are there already are passed over.
        dealt = slices(items, 25)
        step(spark, str(tmp_path / "a"), 1, dealt.where("slice = 1"), rules)
        assert result(place(items, str(tmp_path / "a"), start=50, rules=rules)) == want
    items.unpersist()


def test_an_unfinished_step_does_not_count(spark, tmp_path):
    items = items_of(spark, rows_of(5, 12))
    folder = tmp_path / "log"
    want = result(place(items, str(folder)))
    (folder / "step=0" / "_SUCCESS").unlink()
    assert result(place(items, str(folder))) == want


def item(title, text, at=0.0, lang="en", n=1):
    words = f"{title}\n{text}".lower().split()
    grams = sorted({hash(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))})
    return {"item": n, "title": title, "lang": lang, "at": at, "shingles": grams, "vector": embedded(words), "numbers": [w for w in words if w.isdigit()], "urls": [], "keys": [1]}


def story(x):
    return x | {"vectors": [x["vector"]], "members": 1}


def test_match_scores_and_vetoes():
    a = item("metro line 4 opens", "line 4 metro extension opened today in town")
    rules = Rules()
    assert match(a, story(a), rules) == 0.85
    assert match(a | {"at": 36 * 3600.0}, story(a), rules) == pytest.approx(0.7 + 0.15 * math.exp(-1), abs=1e-4)
    assert match(a | {"at": math.inf}, story(a), rules) == 0.775
    assert match(a | {"urls": ["u"]}, story(a | {"urls": ["u", "v"]}), rules) == 1.0
    assert match(a | {"lang": "fr"}, story(a), rules) == pytest.approx(0.45 * 0.95 + 0.125 + 0.15)
    assert match(a | {"lang": ""}, story(a), rules) == pytest.approx(0.45 * 0.9 + 0.25 * 0.75 + 0.15, abs=1e-4)
    low = rules.thresholds.low - 0.01
    assert match(a | {"numbers": ["5"]}, story(a), rules) == low
    b = item("court approves new bridge plan", "the court decided today on the plan for a bridge")
    assert match(item("court rejects new bridge plan", "the court decided today on the plan for a bridge"), story(item("court approve new bridge plan", "the court decided today on the plan for a bridge")), rules) > low
    assert match(item("court reject new bridge plan", "the court decided today on the plan for a bridge"), story(item("court approve new bridge plan", "the court decided today on the plan for a bridge")), rules) == low
    assert match(b, story(item("weather", "rain")), rules) < 0.52


def test_paraphrase_joins_and_a_different_event_does_not():
    rules = Rules(thresholds=online.Thresholds(high=0.5, low=0.3))
    one = item("OpenLab unveils flagship model", "OpenLab unveiled its flagship model with faster reasoning", n=1)
    two = item("OpenLab introduces flagship model", "OpenLab introduced its newest flagship model with quicker reasoning", n=2)
    given, _ = fold([one, two], {}, rules)
    assert [g["story"] for g in given] == [1, 1] and given[1]["decision"] == "match"
    other = item("Farm exports fall", "grain prices moved lower in spring", n=3)
    given, _ = fold([one, other], {}, rules)
    assert [g["story"] for g in given] == [1, 3] and given[1]["decision"] == "new_story"


def test_ties_go_to_the_older_story_and_order_is_time_then_number():
    a = item("same words here", "same words here and there", n=5)
    given, _ = fold([a | {"item": 9}, a | {"item": 2, "at": 1.0}, a], {}, Rules())
    assert [(g["item"], g["story"]) for g in given] == [(5, 5), (9, 5), (2, 5)]
    s = {7: story(a), 3: story(a)}
    assert fold([a | {"item": 11}], {n: v | {"keys": [1]} for n, v in s.items()}, Rules())[0][0]["story"] == 3


def test_stories_stay_bounded():
    a = item("same words here", "same words here and there", n=1)
    given, changed = fold([a | {"item": n} for n in range(1, 40)], {}, Rules())
    s = changed[1]
    assert s["members"] == 39 and len(s["vectors"]) == 8 and np.isclose(np.linalg.norm(s["vectors"][0]), 1)


def test_empty_table(spark, tmp_path):
    assert place(items_of(spark, rows_of(1)).limit(0), str(tmp_path / "none")).count() == 0
