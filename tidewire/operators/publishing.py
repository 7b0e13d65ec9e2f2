"""Publications: fingerprints, versions, keys, media rules, decisions, and the texts around a post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Media types that a channel takes.
MEDIA_TYPES = ("image/", "video/", "audio/")
LARGEST_MEDIA = 10 * 1024 * 1024
# The states of a publication, and those that may follow each.
NEXT_STATES = {
    "draft": ["ready", "cancelled"], "ready": ["approved", "cancelled"], "approved": ["scheduled", "publishing", "cancelled"],
    "scheduled": ["publishing", "cancelled", "failed"], "publishing": ["published", "failed"], "failed": ["publishing", "scheduled", "cancelled"],
    "published": [], "cancelled": [],
}


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as a JSON object with sorted names; missing values count as null."""
    ordered = [fields[k].alias(k) for k in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def fingerprint(headline: Column, content: Column, **more: Column) -> Column:
    """Hash of what a reader sees; null for an empty draft."""
    h, c = F.trim(F.coalesce(headline, F.lit(""))), F.trim(F.coalesce(content, F.lit("")))
    return F.when((h != "") | (c != ""), canonical_hash(headline=h, content=c, **more))


def post_key(story: Column, version: Column, digest: Column) -> Column:
    """The key that keeps a story from being posted twice in one form."""
    return F.concat(F.lit("story-"), story.cast("string"), F.when(version > 1, F.concat(F.lit("-v"), version.cast("string"))).otherwise(""), F.lit("-"), F.substring(digest, 1, 16))


def not_yet_posted(drafts: DataFrame, posted: DataFrame, key: str) -> DataFrame:
    """The first draft of each key that no earlier post has."""
    return drafts.join(posted.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def may_follow(now: Column, wanted: Column) -> Column:
    """Whether a publication may go from one state to the other."""
    states = F.create_map(*[x for s, to in NEXT_STATES.items() for x in (F.lit(s), F.array(*map(F.lit, to)).cast("array<string>"))])
    return F.coalesce(F.array_contains(states[now], wanted), F.lit(False))


def recent_of(posts: DataFrame, channel: str, at: str, value: str, hours: int = 12, most: int = 30) -> DataFrame:
    """posts with recent: the values of the channel's newest earlier posts within so many hours, at most `most` of them.

    Posts are dealt to spans of that many hours, each also to the next one as history, so that a channel is no one task.
    """
    span = F.floor(F.unix_micros(at) / (hours * 3.6e9)).cast("long")
    dealt = posts.withColumn("__late", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__span", span + F.col("__late"))
    w = W.partitionBy(channel, "__span").orderBy(F.unix_micros(at)).rowsBetween(-most, -1)
    got = dealt.withColumn("__r", F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("value"))).over(w)).where("__late = 0")
    fresh = F.filter("__r", lambda r: r["at"] >= F.col(at) - F.expr(f"interval {hours} hours"))
    return got.withColumn("recent", F.transform(fresh, lambda r: r["value"])).drop("__late", "__span", "__r")


def version_fault(key: Column, version: Column, kind: Column) -> Column:
    """Why a publication may not be stored; null if it may."""
    return (
        F.when(F.coalesce(key, F.lit("")) == "", "no key")
        .when(version < 1, "version below 1")
        .when((kind == "initial") & (version != 1), "initial with a later version")
    )


def next_versions(publications: DataFrame, story: str, version: str, key: str) -> DataFrame:
    """story, next_version, parent: what a material update of each story would be."""
    got = publications.groupBy(story).agg(F.max(version).alias("v"), F.max_by(key, F.struct(version, key)).alias("parent"))
    return got.select(story, F.greatest(F.lit(2), F.col("v") + 1).cast("int").alias("next_version"), "parent")


def media_fault(native: Column, url: Column, refused: Column, kind: Column, size: Column) -> Column:
    """Why a media asset can't be sent; the empty string if it can."""
    wrong = (F.coalesce(kind, F.lit("")) != "") & ~F.coalesce(F.greatest(*[F.startswith(kind, F.lit(p)) for p in MEDIA_TYPES]), F.lit(False))
    return (
        F.when((F.coalesce(native, F.lit("")) != "") & (F.coalesce(url, F.lit("")) == ""), "")
        .when(F.coalesce(url, F.lit("")) == "", "missing_url")
        .when(refused, "refused_address")
        .when(wrong, F.concat(F.lit("unsupported_mime:"), kind))
        .when(size > LARGEST_MEDIA, "file_too_large")
        .otherwise("")
    )


def best_media(media: DataFrame, story: str, width: str, height: str, key: str, most: int = 5) -> DataFrame:
    """A story's widest, then highest, then first media."""
    w = W.partitionBy(story).orderBy(F.desc_nulls_last(width), F.desc_nulls_last(height), F.asc(key))
    return media.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def what(gate_reason: Column, independent: Column, score: Column) -> Column:
    """publish, schedule, hold or skip."""
    return (
        F.when(gate_reason.isNotNull(), "hold").when(independent < 1, "hold").when(F.coalesce(score, F.lit(0.5)) < 0.45, "skip")
        .when(F.coalesce(score, F.lit(0.5)) >= 0.70, "publish").otherwise("schedule")
    )


def depth(title: Column, summary: Column) -> Column:
    """How technical a post may be: 3 for long material, else 2."""
    return F.when(F.length(F.coalesce(title, F.lit(""))) + F.length(F.coalesce(summary, F.lit(""))) > 1500, 3).otherwise(2)


def signature(shown: Column, text: Column, name: Column) -> Column:
    return F.when(F.coalesce(shown, F.lit(False)), F.trim(F.concat(F.lit("-" * 12 + "\n"), F.coalesce(F.nullif(text, F.lit("")), name, F.lit(""))))).otherwise("")


def fill(template: str, **values: Column) -> Column:
    """The template with each __NAME__ replaced by a value; a missing value counts as empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"__{name}__"), F.coalesce(value, F.lit("")))
    return out


def media_kind(kinds: list[str], given: dict[str, Column], declared: Column) -> Column:
    """The kind that a message's declared media names, else the first attachment that it has."""
    low = F.lower(declared)
    named = F.coalesce(*[F.when(F.contains(low, F.lit(k)), k) for k in kinds], F.when(low.isNotNull(), "document"))
    return F.coalesce(named, *[F.when(given[k].isNotNull(), k) for k in kinds if k in given])


def empty_snapshots(published: DataFrame, key: str, at: str, metrics: list[str]) -> DataFrame:
    """The first snapshot of each new post: no metric is known yet."""
    return published.select(key, F.col(at).alias("captured_at"), *[F.lit(None).cast("long").alias(m) for m in metrics])


def cached(requests: DataFrame, results: DataFrame, key: str, asked: str, stored: str, hours: int) -> DataFrame:
    """requests with the newest stored result that is not older than the given time when asked for; null without one."""
    r = results.select(F.col(key).alias("__k"), F.col(stored).alias("__at"), F.struct(*results.columns).alias("result"))
    fresh = (F.col(key) == F.col("__k")) & (F.col("__at") <= F.col(asked)) & (F.col("__at") >= F.col(asked) - F.expr(f"interval {hours} hours"))
    got = requests.join(r, fresh, "left").groupBy(*requests.columns).agg(F.max_by("result", "__at").alias("result"))
    return got
