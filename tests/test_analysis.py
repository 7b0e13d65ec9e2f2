"""Timeline shapes by hand, connected classes by brute force, and the rest of the analysis without a model."""

import json
import random

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import analysis as A
from tidewire.operators.clusters import connected, stories_of
from tidewire.sources.timelines import posts


def read(spark, *bodies):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n long, body string")
    return [r.asDict(True) for r in posts(rows, "body", ["n"], F.lit("home")).orderBy("n", "external_id").collect()]


def test_nested_timeline(spark):
    quoted = {"result": {"rest_id": "7", "legacy": {"full_text": "old"}, "core": {"user_results": {"result": {"legacy": {"screen_name": "ann"}}}}}}
    one = {"rest_id": "1", "legacy": {"full_text": "a", "created_at": "Mon Jan 29 10:00:05 +0200 2024", "favorite_count": 3, "extended_entities": {"media": [{"media_url_https": "u"}]}}, "views": {"count": "9"}, "quoted_status_result": quoted}
    two = {"__typename": "TweetWithVisibilityResults", "tweet": {"rest_id": "2", "legacy": {"text": "b", "retweeted": True, "favorite_count": -1}, "core": {"user_results": {"result": {"core": {"screen_name": "bo"}}}}}}
    entries = [
        {"entryId": "t-1", "content": {"itemContent": {"tweet_results": {"result": one}}}}, {"entryId": "t-2", "content": {"itemContent": {"tweet_results": {"result": two}}}},
        {"entryId": "t-3", "content": {"rest_id": "3", "legacy": {"full_text": "c", "lang": "fa"}}}, {"entryId": "t-4", "content": {"tweet": {"id": "4", "text": "d", "created_at": "2024-01-29T10:00:00Z"}}},
        {"entryId": "t-5", "content": {"itemContent": {"tweet_results": {"result": {"legacy": {"full_text": "no id"}}}}}}, {"entryId": "Cursor-Bottom-1", "content": {"value": "first"}},
        {"entryId": "x", "content": {"cursorType": "Bottom", "cursor": "second"}}, {"entryId": "cursor-bottom-2", "content": {"value": ""}},
    ]
    got = read(spark, json.dumps({"instructions": [{"type": "clear"}, {"entries": entries}]}))
    assert [(r["external_id"], r["author"], r["text"], r["language"], r["cursor"]) for r in got] == [
        ("1", "home", "a", "und", "second"), ("2", "bo", "b", "und", "second"), ("3", "home", "c", "fa", "second"), ("4", "home", "d", "und", "second"),
    ]
    first, second = got[0], got[1]
    assert first["created"].timestamp() == 1706515205
    assert (first["likes"], first["views"], first["is_quote"], first["quoted_id"], first["quoted_author"], first["quoted_text"]) == (3, 9, True, "7", "ann", "old")
    assert first["media"] == [{"type": "photo", "url": "u"}]
    assert (second["likes"], second["is_repost"]) == (None, True)


def test_other_shapes_and_broken_ones(spark):
    page = '<p><script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"timeline": {"entries": [{"content": {"tweet": {"id_str": "5", "text": "e"}}}, {"id": "6", "full_text": "f", "user": {"screen_name": "cy"}}, {"content": {}}]}}}}) + "</script>"
    got = read(
        spark, '{"tweets":[{"id":"1","text":"a","author":{"username":"x"}}],"next_cursor":"n"}', '{"data":[{"id":"2","author_id":"9"}],"meta":{"next_token":"m"}}', '[{"id":"3"},4]',
        page, "", "{broken", "plain", None, '{"tweets":[]}', "[]",
    )
    assert [(r["n"], r["shape"], r["external_id"], r["author"], r["cursor"]) for r in got if r["n"] != 2] == [
        (0, "tweets", "1", "x", "n"), (1, "data", "2", "home", "m"), (3, "embedded", "5", "home", None), (3, "embedded", "6", "cy", None),
    ]
    assert {r["n"] for r in got} <= {0, 1, 2, 3}


def test_connected_classes(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(5, 5), (100, 101)]
    root = {n: n for p in pairs for n in p}
    while any(root[a] != root[b] for a, b in pairs):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    alone = {n for n in root if all(a == b for a, b in pairs if n in (a, b))}
    assert got == {n: r for n, r in root.items() if n not in alone}
    none = spark.createDataFrame([], "a long, b long")
    assert connected(none).isEmpty()
    items = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    same = spark.createDataFrame([(1, 1), (2, 1)], "k long, first_key long")
    assert sorted(map(tuple, stories_of(items, "k", same, none).collect())) == [(1, 1, True), (2, 1, False), (3, 3, True)]


def test_cleanup_and_judgements(spark):
    rows = spark.createDataFrame([("  بدون شک  خوب  .\n\n\n\nپایان ",), (None,), ("همانطور که می‌دانید بله",)], "t string")
    assert [r[0] for r in rows.select(T.persian(F.col("t"))).collect()] == ["خوب.\n\nپایان", "", "بله"]
    d = spark.createDataFrame(
        [("ambiguous", 1, "SAME_EVENT", 0.8, False), ("ambiguous", 1, "SAME_EVENT", 0.79, False), ("ambiguous", 1, "SAME_EVENT", 0.9, True), ("ambiguous", None, "SAME_EVENT", 0.9, False), (None, 1, "SAME_EVENT", 0.9, False), ("ambiguous", 1, None, None, None)],
        "decision string, candidate long, label string, confidence double, assigned boolean",
    )
    assert [r["status"] for r in A.judged(d).collect()] == ["applied", "held", "held", "skipped", "skipped", "held"]
