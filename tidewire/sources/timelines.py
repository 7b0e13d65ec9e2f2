"""Timeline responses of a post service, in any of their five shapes, as rows of posts.

A response is a JSON text: nested instructions with entries, an object with `tweets`, an object with a list `data`, a bare
list, or the page of an embedded timeline, whose JSON is in a script element or given alone. Each shape is one schema and
one `from_json`, so parsing stays in the JVM; a part that doesn't fit its schema is null, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.numbers import counter

# Field names of the service's documents: fixed values.
_MEDIA = "array<struct<type: string, media_url_https: string, url: string>>"
_QUOTED = (
    "struct<result: struct<rest_id: string, legacy: struct<full_text: string, text: string>, "
    "core: struct<user_results: struct<result: struct<legacy: struct<screen_name: string>>>>>>"
)
_LEGACY = (
    "struct<full_text: string, text: string, created_at: string, lang: string, favorite_count: string, retweet_count: string, reply_count: string, "
    "bookmark_count: string, retweeted: boolean, retweeted_status_result: struct<result: struct<rest_id: string>>, is_quote_status: boolean, "
    f"quoted_status_result: {_QUOTED}, extended_entities: struct<media: {_MEDIA}>, entities: struct<media: {_MEDIA}>>"
)
_USER = "struct<user_results: struct<result: struct<legacy: struct<screen_name: string>, core: struct<screen_name: string>>>>"
_NODE = {
    "rest_id": "string", "id": "string", "text": "string", "created_at": "string", "legacy": _LEGACY, "core": _USER,
    "views": "struct<count: string>", "quoted_status_result": _QUOTED,
}
_NODES = ", ".join(f"{k}: {v}" for k, v in _NODE.items())
_RESULT = f"struct<__typename: string, tweet: struct<{_NODES}>, {_NODES}>"
_INSTRUCTIONS = (
    "array<struct<entries: array<struct<entryId: string, content: struct<cursorType: string, value: string, cursor: string, "
    f"itemContent: struct<tweet_results: struct<result: {_RESULT}>>, tweet: {_RESULT}, __typename: string, {_NODES}>>>>>"
)
_TIMELINE = f"struct<timeline: struct<instructions: {_INSTRUCTIONS}>>"
NESTED = (
    f"data struct<user: struct<result: struct<timeline_v2: {_TIMELINE}, timeline: struct<instructions: {_INSTRUCTIONS}>>>, instructions: {_INSTRUCTIONS}>, "
    f"instructions {_INSTRUCTIONS}"
)
_FLAT = (
    "struct<id: string, text: string, created_at: string, lang: string, is_retweet: boolean, author_id: string, author: struct<username: string>, "
    "public_metrics: map<string, string>>"
)
FLAT = f"tweets array<{_FLAT}>, next_cursor string, data array<{_FLAT}>, meta struct<next_token: string>"
_EMBED = (
    "id_str: string, id: string, text: string, full_text: string, created_at: string, lang: string, favorite_count: string, retweet_count: string, "
    "reply_count: string, user: struct<screen_name: string>, retweeted_status: string"
)
EMBEDDED = f"props struct<pageProps: struct<timeline: struct<entries: array<struct<content: struct<tweet: struct<{_EMBED}>, {_EMBED}>, {_EMBED}>>>>>"
_SCRIPT = r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>'


def _filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def moment(raw: Column) -> Column:
    """A time like `Mon Jan 29 10:00:00 +0000 2024`, or an ISO one; null if it is neither."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(raw, r"^\w{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy")), F.try_to_timestamp(raw))


def _row(**columns: Column) -> Column:
    names = ["external_id", "author", "text", "created", "language", "likes", "reposts", "replies", "saves", "views", "is_repost", "reposted_id", "is_quote", "quoted_id", "quoted_author", "quoted_text", "media"]
    kinds = dict.fromkeys(("likes", "reposts", "replies", "saves", "views"), "bigint") | {"created": "timestamp", "is_repost": "boolean", "is_quote": "boolean", "media": "array<struct<type: string, url: string>>"}
    return F.struct(*[columns.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names])


def _nested_post(t: Column, author: Column) -> Column:
    old = t["legacy"]
    user = t["core"]["user_results"]["result"]
    quoted = F.coalesce(t["quoted_status_result"], old["quoted_status_result"])
    seen = quoted["result"]
    media = F.transform(F.coalesce(old["extended_entities"], old["entities"])["media"], lambda m: F.struct(F.coalesce(m["type"], F.lit("photo")).alias("type"), _filled(m["media_url_https"], m["url"]).alias("url")))
    counts = {"likes": "favorite_count", "reposts": "retweet_count", "replies": "reply_count", "saves": "bookmark_count"}
    return _row(
        external_id=_filled(t["rest_id"], t["id"]), author=_filled(user["legacy"]["screen_name"], user["core"]["screen_name"], author),
        text=F.coalesce(_filled(old["full_text"], old["text"], t["text"]), F.lit("")), created=moment(_filled(old["created_at"], t["created_at"])),
        language=F.coalesce(_filled(old["lang"]), F.lit("und")), views=counter(t["views"]["count"]), **{n: counter(old[f]) for n, f in counts.items()},
        is_repost=old["retweeted_status_result"].isNotNull() | F.coalesce(old["retweeted"], F.lit(False)), reposted_id=old["retweeted_status_result"]["result"]["rest_id"],
        is_quote=quoted.isNotNull() | F.coalesce(old["is_quote_status"], F.lit(False)), quoted_id=seen["rest_id"],
        quoted_author=seen["core"]["user_results"]["result"]["legacy"]["screen_name"], quoted_text=_filled(seen["legacy"]["full_text"], seen["legacy"]["text"]), media=media,
    )


def _flat_post(p: Column, author: Column) -> Column:
    m = lambda name: counter(F.element_at(p["public_metrics"], F.lit(name)))
    return _row(
        external_id=_filled(p["id"]), author=_filled(p["author"]["username"], F.when(p["author"].isNull() & p["author_id"].isNotNull(), author)), text=p["text"], created=moment(p["created_at"]),
        language=F.coalesce(_filled(p["lang"]), F.lit("und")), likes=m("like_count"), reposts=m("retweet_count"), replies=m("reply_count"), saves=m("bookmark_count"),
        views=m("impression_count"), is_repost=F.coalesce(p["is_retweet"], F.lit(False)), is_quote=F.lit(False),
    )


def _embedded_post(e: Column, author: Column) -> Column:
    of = lambda name: F.coalesce(e["content"]["tweet"][name], e["content"][name], e[name])
    return _row(
        external_id=_filled(of("id_str"), of("id")), author=_filled(of("user")["screen_name"], author), text=F.coalesce(_filled(of("text"), of("full_text")), F.lit("")),
        created=moment(of("created_at")), language=F.coalesce(_filled(of("lang")), F.lit("und")), likes=counter(of("favorite_count")), reposts=counter(of("retweet_count")),
        replies=counter(of("reply_count")), is_repost=of("retweeted_status").isNotNull(), is_quote=F.lit(False),
    )


def posts(responses: DataFrame, body: str, keep: list[str], author: Column) -> DataFrame:
    """keep, shape, cursor (where the next page starts) and a post's columns: a row for each post with an id.

    `author` stands in where a post names none. A response that is no JSON of a known shape, and one without posts, gives no
    rows. Where several entries name a cursor, the last one counts.
    """
    raw = F.trim(F.col(body))
    page = F.regexp_extract(raw, _SCRIPT, 1)
    text = F.when(raw.rlike(r"^[{\[]"), raw).otherwise(F.nullif(page, F.lit("")))
    r = responses.select(*keep, author.alias("__author"), text.alias("__t"))
    r = r.withColumns({
        "__list": F.when(F.col("__t").startswith("["), F.from_json("__t", f"array<{_FLAT}>")), "__flat": F.from_json("__t", FLAT),
        "__page": F.from_json("__t", EMBEDDED)["props"]["pageProps"]["timeline"]["entries"], "__deep": F.from_json("__t", NESTED),
    })
    deep = F.col("__deep")
    result = deep["data"]["user"]["result"]
    steps = F.coalesce(result["timeline_v2"]["timeline"]["instructions"], result["timeline"]["instructions"], deep["instructions"], deep["data"]["instructions"])
    entries = F.flatten(F.transform(steps, lambda s: F.coalesce(s["entries"], F.array())))
    last = lambda e: F.lower(F.coalesce(e["entryId"], F.lit(""))).contains("bottom") | (F.lower(F.coalesce(e["content"]["cursorType"], F.lit(""))) == "bottom")
    named = F.filter(F.transform(F.filter(entries, last), lambda e: _filled(e["content"]["value"], e["content"]["cursor"])), lambda c: c.isNotNull())

    def node(e: Column) -> Column:
        c = e["content"]
        whole = lambda x: F.when(x["__typename"] == "TweetWithVisibilityResults", x["tweet"]).otherwise(F.struct(*[x[f].alias(f) for f in _NODE]))
        own = c["itemContent"]["tweet_results"]["result"]
        inner = F.when(c["tweet"].isNotNull(), whole(c["tweet"]))
        return F.when(own.isNotNull(), whole(own)).when(c["legacy"].isNotNull(), F.struct(*[c[f].alias(f) for f in _NODE])).otherwise(inner)

    who = F.col("__author")
    flat = F.col("__flat")
    kinds = [
        ("list", F.col("__list"), F.lit(None).cast("string"), lambda p: _flat_post(p, F.lit(None).cast("string"))),
        ("tweets", flat["tweets"], flat["next_cursor"], lambda p: _flat_post(p, F.lit(None).cast("string"))),
        ("data", flat["data"], flat["meta"]["next_token"], lambda p: _flat_post(p, who)),
        ("embedded", F.col("__page"), F.lit(None).cast("string"), lambda p: _embedded_post(p, who)),
        ("nested", F.filter(entries, lambda e: ~last(e)), F.try_element_at(named, F.lit(-1)), lambda e: _nested_post(node(e), who)),
    ]
    got = F.lit(None)
    for name, rows, cursor, post in reversed(kinds):
        got = F.when(rows.isNotNull(), F.struct(F.lit(name).alias("shape"), cursor.alias("cursor"), F.transform(rows, post).alias("posts"))).otherwise(got)
    found = r.select(*keep, got.alias("__got")).select(*keep, F.col("__got.shape").alias("shape"), F.col("__got.cursor").alias("cursor"), F.explode("__got.posts").alias("__p"))
    return found.select(*keep, "shape", "cursor", "__p.*").where(F.col("external_id").isNotNull())
