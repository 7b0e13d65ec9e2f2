"""Message exports and short posts as sources of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.numbers import counter

MESSAGE = (
    "id long, date timestamp, edit_date timestamp, text string, caption string, views long, forwards long, service string, author_signature string, "
    "media struct<kind: string, media_group_id: string, mime_type: string, file_name: string, file_size: long, width: int, height: int, duration: int>, "
    "reactions array<struct<label: string, count: long>>, "
    "forward_origin struct<type: string, date: timestamp, chat_title: string, chat_username: string, sender_name: string, message_id: long>, "
    "forward_from_chat struct<title: string, username: string>, forward_from_message_id long"
)
POST = (
    "id string, text string, author struct<username: string>, created_at timestamp, lang string, is_retweet boolean, "
    "public_metrics map<string, string>, metrics map<string, string>, referenced_tweet struct<id: string, author: string, text: string>, "
    "media array<struct<type: string, url: string>>"
)


def chat_name(identifier: Column) -> Column:
    """@name of a t.me address or a bare name; numeric ids stay."""
    name = F.regexp_extract(identifier, r"^(?:https?://)?t\.me/(?:s/)?([A-Za-z0-9_]+)", 1)
    bare = F.when(name != "", name).otherwise(F.regexp_replace(identifier, "^@", ""))
    return F.when(identifier.rlike(r"^-?\d+$"), identifier).otherwise(F.concat(F.lit("@"), bare))


def public_url(user: Column, message: Column) -> Column:
    return F.when((F.coalesce(user, F.lit("")) != "") & message.isNotNull(), F.concat(F.lit("https://t.me/"), F.regexp_replace(user, "^@", ""), F.lit("/"), message.cast("string"))).otherwise("")


def content_type(kind: Column) -> Column:
    return F.when(kind == "poll", "poll").when(kind.isin("video", "animation", "video_note"), "video").when(kind == "photo", "image").when(kind.isin("audio", "voice"), "audio").otherwise("post")


def reaction_total(reactions: Column) -> Column:
    """The sum of an array of (label, count); null, not 0, if there is none."""
    return F.when(F.size(reactions) > 0, F.aggregate(reactions, F.lit(0).cast("long"), lambda s, r: s + F.coalesce(r["count"], F.lit(0))))


def read_messages(spark: SparkSession, path: str, chat: str, after: int = 0, lookback: int = 25) -> DataFrame:
    """Items of a JSON export: those from the cursor on and `lookback` messages before it, for late edits; service and empty
    messages are skipped, and each id comes once, in its last edit."""
    m = spark.read.schema(MESSAGE).json(path).where(F.col("id") >= max(0, after - lookback))
    body = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.nullif(F.col("caption"), F.lit("")))
    m = m.where(F.col("service").isNull() & (body.isNotNull() | F.col("media").isNotNull()))
    last = m.groupBy("id").agg(F.max_by(F.struct(*[c for c in m.columns if c != "id"]), F.coalesce("edit_date", "date")).alias("r")).select("id", "r.*")
    origin = F.coalesce(F.col("forward_origin.chat_title"), F.col("forward_from_chat.title"), F.col("forward_origin.sender_name"))
    return last.select(
        F.col("id").cast("string").alias("external_id"), public_url(F.lit(chat), F.col("id")).alias("url"), F.coalesce(F.nullif(F.col("text"), F.lit("")), "caption").alias("text"),
        F.col("date").alias("published_at"), F.col("edit_date").alias("updated_at"), counter(F.col("views")).alias("views"), counter(F.col("forwards")).alias("forwards"),
        reaction_total(F.col("reactions")).alias("reactions"), F.map_from_entries(F.col("reactions")).alias("reaction_breakdown"), content_type(F.col("media.kind")).alias("content_type"),
        origin.alias("forward_title"), F.col("author_signature").alias("author"),
    )


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON timeline. Either metrics map counts; reposts are both forwards and shares; a counter that is no
    number or negative is unknown."""
    p = spark.read.schema(POST).json(path)
    m = lambda *names: F.coalesce(*[counter(F.element_at(F.col(c), F.lit(n))) for n in names for c in ("metrics", "public_metrics")])
    return p.select(
        F.col("id").alias("external_id"), F.concat(F.lit("https://x.com/"), F.col("author.username"), F.lit("/status/"), F.col("id")).alias("url"), F.substring("text", 1, 220).alias("title"), "text",
        F.col("created_at").alias("published_at"), F.col("author.username").alias("author"), F.coalesce("lang", F.lit("")).alias("language"),
        m("views", "impression_count").alias("views"), m("retweets", "retweet_count").alias("forwards"), m("retweets", "retweet_count").alias("shares"),
        m("likes", "like_count").alias("reactions"), m("replies", "reply_count").alias("replies"), m("bookmarks", "bookmark_count").alias("saves"),
        F.coalesce("is_retweet", F.lit(False)).alias("is_repost"), F.col("referenced_tweet").alias("quoted"), "media",
    )


def first_count(document: Column, paths: list[str]) -> Column:
    """The first whole number from 0 at one of the paths of a JSON document; truth values and other texts are none."""
    found = [F.get_json_object(document, p) for p in paths]
    return F.coalesce(*[F.when(x.rlike(r"^\d+$"), x.try_cast("bigint")) for x in found])
