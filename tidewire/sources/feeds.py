"""RSS and Atom feeds as a source of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.sources.pages import iso_time

RSS = "title string, link string, guid string, pubDate string, author string, description string, `content:encoded` string, enclosure struct<_url: string, _length: long, _type: string>"
ATOM = (
    "title string, link struct<_href: string>, id string, updated string, published string, author struct<name: string>, summary string, "
    "content struct<_VALUE: string, _type: string>"
)


def feed_time(text: Column) -> Column:
    """RFC 822 without regard to the day's name, else ISO; null otherwise. A missing date is never made up."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s*[A-Za-z]{3,},\s*", ""), r"\s(UT|Z)$", " GMT")
    tries = [F.try_to_timestamp(bare, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z")]
    return F.coalesce(*tries, iso_time(text))


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """external_id (guid, else link), url, title, text (content before description), author, published_at, media."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(RSS).load(path)
    media = F.when(F.col("enclosure").isNotNull(), F.array(F.struct(F.col("enclosure._url").alias("url"), F.col("enclosure._type").alias("type"))))
    return rows.select(
        F.coalesce("guid", "link").alias("external_id"), F.col("link").alias("url"), "title", F.coalesce("`content:encoded`", "description").alias("text"),
        "author", feed_time(F.col("pubDate")).alias("published_at"), media.alias("media"),
    )


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    return rows.select(
        F.coalesce("id", "link._href").alias("external_id"), F.col("link._href").alias("url"), "title", F.coalesce("content._VALUE", "summary").alias("text"),
        F.col("author.name").alias("author"), feed_time(F.coalesce("published", "updated")).alias("published_at"),
        F.lit(None).cast("array<struct<url: string, type: string>>").alias("media"),
    )


def route_url(base: Column, route: Column, params: Column) -> Column:
    """A feed bridge's address: base and route without doubled slashes, and a map of parameters."""
    query = F.array_join(F.transform(F.array_sort(F.map_keys(params)), lambda k: F.concat(F.url_encode(k), F.lit("="), F.url_encode(F.element_at(params, k)))), "&")
    address = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(route, "^/+", ""))
    return F.when(F.coalesce(F.size(params), F.lit(0)) > 0, F.concat(address, F.lit("?"), query)).otherwise(address)
