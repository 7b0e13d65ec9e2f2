"""Queries that SQL does not decide, against plain Python over whole small tables."""

import html
import re

import pytest
from pyspark.sql import functions as F

from tidewire.functions import urls as U
from tidewire.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_minhash_similarity(spark):
    """Pairs and exact similarities by comparing all sets; estimates from 128 slots lie near them."""
    first = {}
    for r in rows(spark, "documents"):
        if r.text.strip():
            first[r.text] = min(r.doc_id, first.get(r.text, r.doc_id))
    sets = {}
    for text, i in first.items():
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    ids = sorted(sets)
    want = {}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= 0.5:
                want[a, b] = round(j, 4)
    got = catalogue.QUERIES["minhash_similarity"](spark, SF).collect()
    assert {(r.a, r.b): r.jaccard for r in got} == want and want
    assert all(abs(r.estimate - r.jaccard) <= 0.25 and round(r.estimate * 128, 6) % 1 == 0 for r in got)
    assert abs(sum(r.estimate - r.jaccard for r in got)) / len(got) < 0.05


def test_html_article_text(spark):
    import hashlib

    want = {}
    for r in rows(spark, "pages"):
        title = re.search(r"<title>(.*?)</title>", r.html, re.S)
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        runs = [re.split(r"</p>", p)[0] for p in re.split(r"<p>", article)[1:]]  # some paragraphs are not closed
        parts = [" ".join(html.unescape(re.sub(r"<b>", "", re.sub(r"<br>", " ", p))).split()) for p in runs]
        text = "\n\n".join(p for p in parts if p)
        want[r.page_id] = (" ".join(html.unescape(title[1]).split()) if title else "", len(text), hashlib.sha256(text.encode()).hexdigest(), False)
    got = {r.page_id: (r.title, r.text_chars, r.text_hash, r.failed) for r in catalogue.QUERIES["html_article_text"](spark, SF).collect()}
    assert got == want


def next_trend(now, mom, acc, independent, items):
    """As the rules are written, with confidence 0.5 and two samples."""
    if now == "BREAKING" and mom >= 0.75 or now != "BREAKING" and (mom >= 0.85 or (acc >= 0.4 and independent >= 3 and mom >= 0.75)):
        return "BREAKING"
    if now == "SURGING" and mom >= 0.65 or mom >= 0.75 and acc >= 0.05:
        return "SURGING"
    if now == "RISING" and mom >= 0.5 or mom >= 0.6 and acc >= 0:
        return "RISING"
    if acc >= 0.15 and independent >= 2 and items <= 5:
        return "EARLY_SIGNAL"
    if items >= 8 and acc <= -0.15:
        return "SATURATED"
    return "COOLING" if acc <= -0.1 and mom < 0.45 else "NORMAL"


def next_state(now, trend, mom, acc, age):
    if trend == "BREAKING":
        return "breaking"
    if trend in ("RISING", "SURGING"):
        return "peaking" if now == "breaking" else "rising"
    if trend == "EARLY_SIGNAL" and now in ("discovered", "stale"):
        return "watching"
    if now in ("breaking", "rising") and acc < -0.15:
        return "peaking"
    if now == "peaking" and mom < 0.5:
        return "cooling"
    if now == "cooling" and age > 43_200 and mom < 0.3:
        return "stale"
    if now == "stale" and age > 259_200:
        return "archived"
    return "watching" if now == "discovered" else now


def test_trend_fold(spark):
    days = {}
    for r in rows(spark, "events"):
        days.setdefault(r.user_id, {}).setdefault(r.ts.date(), []).append(r)
    got = {r.user_id: (r.trend, r.state) for r in catalogue.QUERIES["trend_fold"](spark, SF).collect()}
    assert set(got) == set(days) and len(set(got.values())) > 1
    for user, of in days.items():
        trend, state = "NORMAL", "discovered"
        for day in sorted(of):
            v = sum(r.value for r in of[day]) / len(of[day])
            mom, acc = round(max(0, min(1, v / 60)), 4), v / 100 - 0.5
            trend = next_trend(trend, mom, acc, len({r.event_type for r in of[day]}), len(of[day]))
            state = next_state(state, trend, mom, acc, (day - day.replace(year=2024, month=1, day=1)).days * 86400)
        assert got[user] == (trend, state), user


@pytest.mark.parametrize(
    "text, want",
    [
        ("see https://a.b/c?x=1&api_key=abcd&y=2&sig=zz", "see https://a.b/c?x=1&api_key=%5BREDACTED%5D&y=2&sig=%5BREDACTED%5D"),
        ("password: hunter22 and more", "password=[REDACTED] and more"),
        ("API-KEY='abcd-1234'", "API-KEY=[REDACTED]"),
        ("Authorization: bearer abcdefgh.ijk", "Authorization: Bearer [REDACTED]"),
        ("token abc", "token abc"),
        ("a keyboard session", "a keyboard session"),
        ("", ""),
        (None, ""),
    ],
)
def test_redacted_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(U.redact_text(F.col("t")).alias("t")).head().t == want
