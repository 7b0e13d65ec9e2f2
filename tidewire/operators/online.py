"""Online assignment of items to stories, in order of time, with story state that outlives a run.

An item looks at the stories that share a key with it (a band of its MinHash, or an address), takes the best by the match
score against the story as it is by then, and joins it or founds a story of its own. Each item may change the story that
the next one sees, so items that can meet must go one after the other; those that can't need not wait. A step takes the
items of one slice of time: items and stories that are connected by keys form a component, components are dealt out over
the cluster, and each is folded in order of time. The result is that of one long sequence over all items.

The log has one directory a step, written at once: what each item was given, with its keys, and the stories that changed
as they are now. A step reads the directories before its own only, so one that is run again gives the same, and an item
that an earlier step has placed is passed over.

A component is folded by one task. It holds items of one slice that share keys, as copies of one report do, so its size is
bounded by the slice's; its stories are of bounded size each.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import fuzzy
from tidewire.functions import text as T
from tidewire.operators import similarity as S
from tidewire.operators.clusters import connected
from tidewire.operators.matching import OPPOSITES, Thresholds
from tidewire.session import checkpointed

DIM = 128
_STORY = "title string, lang string, at double, shingles array<long>, vectors array<array<double>>, numbers array<string>, urls array<string>, members int"
_LOG = f"kind string, item long, story long, decision string, score double, keys array<long>, {_STORY}"
_SWAPS = {frozenset(p) for p in OPPOSITES}


@dataclass(frozen=True)
class Rules:
    thresholds: Thresholds = field(default_factory=Thresholds)
    candidates: int = 30  # that share most keys; of equal numbers the older
    members: int = 8  # whose shingles and vectors stand for a story
    shingles: int = 2000  # of a story, the least numbers
    hours: float = 36.0


@lru_cache(maxsize=100_000)
def _slot(token: str) -> tuple[int, int]:
    h = hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(h[:4], "little") % DIM, 1 if h[4] % 2 == 0 else -1


def embedded(words) -> list[float]:
    """Signed hash buckets of the words, of length 1 (or all 0)."""
    at = np.array([_slot(w) for w in words], "int64").reshape(-1, 2)
    v = np.bincount(at[:, 0], at[:, 1], DIM).astype(float)
    norm = float(np.linalg.norm(v))
    return (v / norm if norm else v).tolist()


def prepared(items: DataFrame, item: str, at: Column, title: Column, text: Column, lang: Column, bands: int = 8, rows: int = 4) -> DataFrame:
    """The items as a step wants them. `at` is in seconds; a null time comes last. Of several rows of one item the first by
    time, then by hash, counts; a null item, or one without title and text, is left out."""
    title, text = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    raw = items.select(
        F.col(item).cast("long").alias("item"),
        F.coalesce(at.cast("double"), F.lit(float("inf"))).alias("at"),
        title.alias("title"),
        text.alias("text"),
        F.coalesce(lang, F.lit("")).alias("lang"),
    ).where(F.col("item").isNotNull() & (F.concat("title", "text") != ""))
    rest = F.struct("at", F.xxhash64("title", "text", "lang"))
    one = raw.groupBy("item").agg(F.min_by(F.struct("at", "title", "text", "lang"), rest).alias("r")).select("item", "r.*")
    words = T.tokens(F.concat_ws("\n", "title", "text"))
    vector = F.pandas_udf(lambda w: w.map(lambda t: embedded(t.split(" ") if t else [])), "array<double>", F.PandasUDFType.SCALAR)
    got = one.withColumn("words", words).withColumn("meta", T.metadata(F.col("title"), F.col("text")))
    got = got.withColumn("shingles", F.transform(T.shingles(F.col("words")), lambda s: F.xxhash64(s)))
    got = got.withColumn("sketch", S.sketches(bands * rows)("shingles")).withColumn("line", F.array_join("words", " "))
    band = F.when(F.size("sketch") > 0, F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("sketch", b * rows + 1, rows))))
    keys = F.array_union(F.coalesce(band, F.array().cast("array<bigint>")), F.transform("meta.urls", lambda u: F.xxhash64(F.lit("u"), u)))
    return got.select("item", "at", "title", "lang", F.sort_array("shingles").alias("shingles"), vector("line").alias("vector"), "meta.numbers", "meta.urls", F.array_distinct(keys).alias("keys"))


def slices(items: DataFrame, rows: int) -> DataFrame:
    """items with slice (from 0): runs of time of about that many items; rows of one time are of one slice."""
    n = items.count()
    probe = items.where(F.col("at") < float("inf"))
    cuts = sorted(set(probe.approxQuantile("at", [k / math.ceil(n / rows) for k in range(1, math.ceil(n / rows))], 0.001))) if n > rows else []
    return items.withColumn("slice", F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c <= F.col("at"))) if cuts else F.lit(0))


def match(x: dict, s: dict, rules: Rules) -> float:
    """The score of an item against a story as it is, after vetoes, to 4 places."""
    t = rules.thresholds
    title = fuzzy.token_set(x["title"].lower(), s["title"].lower()) / 100
    a, b = set(x["shingles"]), set(s["shingles"])
    jaccard = len(a & b) / len(a | b) if a and b else 0.0
    mean = np.mean(np.array(s["vectors"]), 0)
    norm = float(np.linalg.norm(mean))
    semantic = round(max(-1.0, min(1.0, float(np.dot(x["vector"], mean)) / norm)), 4) if norm else 0.0
    known = math.isfinite(x["at"]) and math.isfinite(s["at"])
    time = math.exp(-abs(x["at"] - s["at"]) / 3600 / rules.hours) if known else 0.5
    urls = set(x["urls"]) & set(s["urls"])
    metadata = len(urls) / min(len(set(x["urls"])), len(set(s["urls"]))) if urls else 0.0
    same = 0.5 if not x["lang"] or not s["lang"] else float(x["lang"] == s["lang"])
    lexical = (title + jaccard) / 2 * (1.0 if same == 1 else 0.75 if same else 0.5)
    meaning = semantic if same == 1 else min(semantic, 0.9 if same else 0.95)
    score = round(min(1.0, max(0.0, t.semantic * meaning + t.lexical * lexical + t.time * time + t.metadata * metadata)), 4)
    p, q = set(x["numbers"]), set(s["numbers"])
    numbers = p and q and not p & q and semantic >= 0.55
    left, right = (set(re.findall("[a-z]{3,}", v["title"].lower())) for v in (x, s))
    left, right = left - right, right - left
    swap = 1 <= len(left) <= 3 and 1 <= len(right) <= 3 and any(frozenset((i, j)) in _SWAPS for i in left for j in right)
    return min(score, t.low - 0.01) if title >= 0.55 and (numbers or swap) else score


def fold(items: list[dict], stories: dict[int, dict], rules: Rules) -> tuple[list[dict], dict[int, dict]]:
    """What each item is given, in order of time and item, and the stories that changed. `stories` is by number, each with
    the keys by which these items can find it."""
    by_key: dict[int, set[int]] = {}
    for n, s in stories.items():
        for k in s["keys"]:
            by_key.setdefault(k, set()).add(n)
    given, changed = [], {}
    for x in sorted(items, key=lambda r: (r["at"], r["item"])):
        shared = Counter(n for k in x["keys"] for n in by_key.get(k, ()))
        best, score = None, -1.0
        for n, _ in sorted(shared.items(), key=lambda c: (-c[1], c[0]))[: rules.candidates]:
            got = match(x, stories[n], rules)
            if got > score:
                best, score = n, got
        decision = "match" if score >= rules.thresholds.high else "ambiguous" if score >= rules.thresholds.low else "new_story"
        if decision == "match":
            s = stories[best] = dict(stories[best])
            if s["members"] < rules.members:
                s["shingles"] = sorted(set(s["shingles"]) | set(x["shingles"]))[: rules.shingles]
                s["vectors"] = [*s["vectors"], x["vector"]]
                s["numbers"] = sorted(set(s["numbers"]) | set(x["numbers"]))
            s["urls"] = sorted(set(s["urls"]) | set(x["urls"]))
            s["members"] += 1
            s["at"] = max(s["at"], x["at"]) if math.isfinite(x["at"]) and math.isfinite(s["at"]) else min(s["at"], x["at"])
        else:
            best = x["item"]
            stories[best] = {"title": x["title"], "lang": x["lang"], "at": x["at"], "shingles": list(x["shingles"])[: rules.shingles], "vectors": [x["vector"]], "numbers": sorted(set(x["numbers"])), "urls": sorted(set(x["urls"])), "members": 1}
        changed[best] = stories[best]
        for k in x["keys"]:
            by_key.setdefault(k, set()).add(best)
        given.append({"item": x["item"], "story": best, "decision": decision, "score": max(score, 0.0), "keys": x["keys"]})
    return given, changed


def _log(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """The log of all steps before that one, by the directories that are there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    steps = sorted(int(n.split("=")[1]) for n in names if n.startswith("step=") and int(n.split("=")[1]) < before)
    done = [f"{folder}/step={k}" for k in steps if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/step={k}/_SUCCESS"))]
    return spark.read.option("basePath", folder).schema(f"{_LOG}, step int").parquet(*done) if done else None


def step(spark: SparkSession, folder: str, number: int, items: DataFrame, rules: Rules = Rules()) -> None:
    """Place the prepared items of one slice and write directory step=number of the log. Numbers rise with time."""
    log = _log(spark, folder, number)
    if log is not None:
        items = items.join(log.where("kind = 'member'").select("item"), "item", "left_anti")
    items = checkpointed(items.select("item", "at", "title", "lang", "shingles", "vector", "numbers", "urls", "keys"))
    keys = items.select("item", F.explode("keys").alias("key"))
    first = keys.groupBy("key").agg(F.min("item").alias("first"))
    links = keys.join(first, "key").select(F.col("first").alias("a"), F.col("item").alias("b"))
    touched = None
    if log is not None:
        known = log.where("kind = 'member'").select("story", F.explode("keys").alias("key")).distinct()
        touched = checkpointed(known.join(first, "key"))
        links = links.union(touched.select("first", F.col("story").alias("b")))
    root = connected(links.distinct())
    rows = items.join(root.withColumnRenamed("node", "item"), "item", "left").select(F.coalesce("root", "item").alias("component"), F.lit("item").alias("kind"), "item", "keys", "title", "lang", "at", "shingles", F.array("vector").alias("vectors"), "numbers", "urls", F.lit(1).alias("members"))
    if touched is not None:
        of = touched.groupBy("story").agg(F.collect_set("key").alias("keys"))
        state = ["title", "lang", "at", "shingles", "vectors", "numbers", "urls", "members"]
        latest = log.where("kind = 'story'").join(of.select("story"), "story", "left_semi").groupBy("story").agg(F.max_by(F.struct(*state), "step").alias("s"))
        old = latest.join(of, "story").join(root.withColumnRenamed("node", "story"), "story")
        rows = rows.unionByName(old.select(F.col("root").alias("component"), F.lit("story").alias("kind"), F.col("story").alias("item"), "keys", *[F.col(f"s.{c}") for c in state]))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        stories, new = {}, []
        for r in g.to_dict("records"):
            r = {k: list(v) if isinstance(v, np.ndarray) else v for k, v in r.items()}
            if r.pop("kind") == "story":
                r["vectors"] = [list(v) for v in r["vectors"]]
                stories[r.pop("item")] = r
            else:
                new.append(r | {"vector": list(r["vectors"][0])})
        given, changed = fold(new, stories, rules)
        out = [{"kind": "member", **x} for x in given]
        out += [{"kind": "story", "item": n, "story": n} | {k: v for k, v in s.items() if k not in ("keys", "component", "bundle")} for n, s in changed.items()]
        names = [f.split()[0] for f in re.sub(r"<.*?>+", "", _LOG).split(", ")]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in out], dtype=object) for n in names})

    def each(g: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([run(c) for _, c in g.groupby("component", sort=False)])

    bundles = max(1, items.count() // 256)  # most components are one item, which isn't worth a call
    dealt = rows.withColumn("bundle", F.pmod(F.xxhash64("component"), F.lit(bundles)))
    dealt.groupBy("bundle").applyInPandas(each, _LOG).write.mode("overwrite").parquet(f"{folder}/step={number}")


def place(items: DataFrame, folder: str, rows: int = 1_000_000, start: int = 0, rules: Rules = Rules()) -> DataFrame:
    """item, story, decision, score of all prepared items: one step for each slice of about `rows` of them, from number
    `start` on. With a log of earlier runs in the folder, that goes on from there."""
    spark = items.sparkSession
    dealt = checkpointed(slices(items, rows))
    numbers = [r["slice"] for r in dealt.select("slice").distinct().orderBy("slice").collect()]
    for number in numbers:
        step(spark, folder, start + number, dealt.where(F.col("slice") == number), rules)
    log = _log(spark, folder, 1 << 30)
    wanted = ["item", "story", "decision", "score"]
    return log.where("kind = 'member'").select(*wanted) if log is not None else spark.createDataFrame([], "item long, story long, decision string, score double")
