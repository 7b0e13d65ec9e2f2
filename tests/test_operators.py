"""Golden values of the scalar and domain operators, by single rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewire.functions import fuzzy
from tidewire.functions import numbers as N
from tidewire.functions import text as T
from tidewire.functions import urls as U
from tidewire.operators import baselines, intake, matching, momentum, ranking, series, similarity


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda c: row.select(c.alias("v")).head()["v"]


def test_urls(one):
    url = lambda u: one(U.canonical_url(F.lit(u)))
    assert url("HTTP://Example.COM:80/a/?utm_source=x&b=2&a=1#f") == "http://example.com/a?a=1&b=2"
    assert url("https://e.com") == "https://e.com/" and url("") == "" and url("https://e.com/x%2Fy/?FBCLID=1") == "https://e.com/x%2Fy"
    assert one(U.redact_url(F.lit("https://h/f?key=s1&limit=10"))) == "https://h/f?key=%5BREDACTED%5D&limit=10"
    assert one(U.effective_url(F.lit("https://a.com/x/y"), F.lit("/z"))) == "https://a.com/z"
    assert one(U.effective_url(F.lit("https://a.com/x"), F.lit("https://evil.com/z"))) == "https://a.com/x"
    assert "REDACTED" in one(U.redact_text(F.lit("password: hunter22")))


def test_text(one):
    assert one(T.normalize(F.lit("<p>a&amp;b</p>x  y\r\n\n\n\n z‌ ي"))) == "a&b\nx y\n\nz ی"
    assert one(T.row_hash(F.lit("  \n"))) is None and one(T.text_hash(F.lit(None).cast("string"))) == ""
    assert one(F.size(T.shingles(T.tokens(F.lit("a b c d e f"))))) == 2 and one(F.size(T.shingles(T.tokens(F.lit(" "))))) == 0
    m = one(T.metadata(F.lit("T"), F.lit("see https://www.e.com/x #Tag @user 1,200 USD 50")))
    assert m.domains == ["e.com"] and m.hashtags == ["tag"] and m.mentions == ["user"] and m.numbers[0] == "1,200" and m.media_present
    assert one(T.balanced_tags(F.lit("<b>x</b><i>")))is False
    assert one(T.truncate_at_sentence(F.lit("One two. Three four five six"), 14)) == "One two."


def test_numbers(one):
    p = {k: F.lit(v) for k, v in zip(("p25", "p50", "p75", "p90", "p95", "p99"), (100, 500, 1000, 2000, 5000, 10000))}
    est = lambda x: one(N.inverse_percentile(F.lit(x).cast("double"), p))
    assert est(500) == 0.50 and est(20000) == 0.9999 and est(None) is None
    assert one(N.nearest_milestone(F.lit(20))) == 10 and one(N.next_milestone(F.lit(600))) == 30 and one(N.next_milestone(F.lit(10**6))) is None
    assert one(N.clamp01(F.lit(float("nan")))) == 0.0 and one(N.counter(F.lit("-3"))) is None
    assert one(N.parse_schedule(F.lit("30, 10,x,-5,10"))) == [10, 30]
    assert one(N.blend([(F.lit(None).cast("double"), 0.4), (F.lit(0.5), 0.3)])) == 0.5
    assert one(N.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_percentile_of_ten_to_hundred(spark):
    rows = spark.createDataFrame([(1, float(x)) for x in range(10, 101, 10)], "k int, v double")
    got = baselines.percentiles(rows, ["k"], F.col("v")).head()
    assert got.p50 == 55.0 and got.sample_count == 10 and got.confidence == 0.3333


def test_fuzzy():
    assert fuzzy.ratio("kitten", "sitting") == pytest.approx(2 * 4 / 13 * 100)
    assert fuzzy.token_sort("b a", "a b") == 100 and fuzzy.token_set("a b c", "a b") == 100
    assert fuzzy.partial("bcd", "abcde") == 100 and fuzzy.weighted("", "x") == 0


def test_matching(one):
    same = matching.match_score(F.lit(1.0), F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(1.0))
    assert one(same) == 0.775 and one(matching.decision(same)) == "ambiguous"
    assert one(matching.opposite_words(F.lit("court passes bill today"), F.lit("court rejects bill today"), F.lit(0.9)))
    assert one(matching.near_identical_length(F.lit("a" * 100), F.lit("b" * 96)))
    assert one(matching.independence(F.lit(False), F.lit(True), F.lit(False), F.lit(2.0))).label == "likely_copy"


def test_independence_counts(spark):
    rows = spark.createDataFrame([(1, "independent")] + [(1, "likely_copy")] * 19, "s int, label string")
    got = matching.independent_counts(rows, ["s"], "label").head()
    assert (got.observed, got.independent) == (20, 1)


def test_series_and_states(spark, one):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, t, 1000), (1, t + dt.timedelta(hours=1), 100), (1, t + dt.timedelta(hours=2), None)], "i int, at timestamp, views int")
    assert [r.velocity for r in series.interval_velocity(rows, "i", "at", "views").orderBy("at").collect()] == [None, 0.0, None]
    assert one(series.ewma(F.array(F.lit(1.0), F.lit(2.0)))) == pytest.approx(1.3)
    assert one(momentum.trend(F.lit("BREAKING"), F.lit(0.76), F.lit(0.0), F.lit(1), F.lit(1), F.lit(0.1), F.lit(1))) == "BREAKING"
    assert one(momentum.lifecycle(F.lit("cooling"), F.lit("NORMAL"), F.lit(0.2), F.lit(0.0), F.lit(50_000))) == "stale"
    assert one(momentum.normal_velocity(F.lit(0.0))) == 0.5


def test_ranking(one):
    assert one(ranking.editorial(F.lit("pass"), F.lit("NEW"), F.lit(0.7), F.lit(False), F.lit(3), F.lit(0.5), F.lit(0.5))) == "PUBLISH_NOW"
    assert one(ranking.reward(F.lit(1.0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0.2))) == 0.3
    assert one(ranking.gate(F.lit(0.2), F.lit(0.0), F.lit(3), F.lit(0.9))) == "low_credibility"


def test_intake(spark):
    rows = spark.createDataFrame([(1, "a", "x", "h1"), (2, "a", "x", "h2"), (3, "a", None, "h1"), (4, "b", "x", "h1"), (5, "a", None, None)], "id int, src string, ext string, h string")
    got = {r.id: r.outcome for r in intake.same_source_outcome(rows, "src", ["ext", "h"], "id").collect()}
    assert got == {1: "created", 2: "duplicate_ext", 3: "duplicate_h", 4: "created", 5: "created"}
    again = intake.new_rows(rows, rows.where("id = 1"), "src", ["ext", "h"])
    assert {r.id for r in again.collect()} == {4, 5}


def test_jaccard_pairs(spark):
    rows = spark.createDataFrame([(1, "a b c d".split()), (2, "a b c e".split()), (3, "x y".split()), (4, [])], "id int, t array<string>")
    got = similarity.jaccard_pairs(similarity.token_sets(rows, "id", F.col("t")), "id", 0.5).collect()
    assert [(r.a, r.b, r.jaccard) for r in got] == [(1, 2, 0.6)]
