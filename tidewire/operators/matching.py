"""Pair features, match scores, vetoes, assignment and evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.functions import numbers as N
from tidewire.functions import text as T

# Word pairs that turn an event into its opposite.
OPPOSITES = [
    ("passes", "rejects"), ("pass", "reject"), ("passed", "rejected"), ("approve", "reject"), ("approved", "rejected"), ("win", "lose"),
    ("wins", "loses"), ("won", "lost"), ("victory", "defeat"), ("launch", "delay"), ("launches", "delays"), ("launched", "delayed"),
    ("cut", "hire"), ("cuts", "hires"), ("cutting", "hiring"), ("raise", "cut"), ("raises", "cuts"), ("increase", "decrease"),
    ("rise", "fall"), ("rises", "falls"), ("hits", "falls"), ("approve", "delay"), ("hold", "raise"), ("holds", "raises"),
    ("steady", "raise"), ("found", "lost"),
]


@dataclass(frozen=True)
class Thresholds:
    high: float = 0.78
    low: float = 0.52
    semantic: float = 0.45
    lexical: float = 0.25
    time: float = 0.15
    metadata: float = 0.15


def language_match(a: Column, b: Column) -> Column:
    """1 for equal languages, 0 for different ones, one half if one is unknown (empty)."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((a == "") | (b == ""), 0.5).otherwise((a == b).cast("double"))


def lexical(*scores: Column) -> Column:
    return N.mean_of_known(*scores)


def match_score(semantic: Column, lexical: Column, time: Column, metadata: Column, language: Column, t: Thresholds = Thresholds()) -> Column:
    """Weighted sum to 4 places. Different languages halve the lexical part and bound the semantic one, unsure ones less."""
    s = F.coalesce(semantic, F.lit(0.0))
    lex = F.when(language == 0, lexical * 0.5).when(language == 0.5, lexical * 0.75).otherwise(lexical)
    sem = F.when(language == 0, F.least(s, F.lit(0.95))).when(language == 0.5, F.least(s, F.lit(0.9))).otherwise(s)
    return N.clamp01(t.semantic * sem + t.lexical * lex + t.time * time + t.metadata * metadata)


def decision(score: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(score >= t.high, "match").when(score >= t.low, "ambiguous").otherwise("new_story")


def conflicting_numbers(a: Column, b: Column, title: Column, semantic: Column) -> Column:
    """Both sides have numbers but share none, while title and meaning agree."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) == 0) & (title >= 0.55) & (semantic >= 0.55)


def opposite_words(a: Column, b: Column, title: Column) -> Column:
    """The sides differ by one to three content words each, among them an opposite pair."""
    words = F.struct(T.content_words(a).alias("x"), T.content_words(b).alias("y"))
    swaps = [f"{p} {q}" for one, other in OPPOSITES for p, q in ((one, other), (other, one))]

    def opposite(s: Column) -> Column:
        few = (F.size(s["x"]) >= 1) & (F.size(s["x"]) <= 3) & (F.size(s["y"]) >= 1) & (F.size(s["y"]) <= 3)
        return few & F.exists(s["x"], lambda p: F.exists(s["y"], lambda q: F.concat_ws(" ", p, q).isin(swaps)))

    # Each text is searched for words once; written out for every pair of opposites it was searched two hundred times.
    apart = T.bound(words, lambda w: F.struct(F.array_except(w["x"], w["y"]).alias("x"), F.array_except(w["y"], w["x"]).alias("y")))
    return T.bound(apart, opposite) & (title >= 0.55)


def vetoed(score: Column, veto: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(veto, F.least(score, F.lit(t.low - 0.01))).otherwise(score)


def method(shared_url: Column, semantic: Column, lexical: Column) -> Column:
    return F.when(shared_url, "shared_url").when(F.coalesce(semantic, F.lit(0.0)) >= lexical, "semantic").otherwise("lexical")


def near_identical_length(a: Column, b: Column) -> Column:
    """The shorter stripped text has at least 0.95 of the longer's length: a length test only."""
    x, y = F.length(T.strip(a)), F.length(T.strip(b))
    return F.coalesce((x > 0) & (y > 0) & (F.least(x, y) / F.greatest(x, y) >= 0.95), F.lit(False))


def independence(forwarded: Column, near: Column, shared_url: Column, gap_hours: Column) -> Column:
    """label, score, reason of a membership."""
    signal = shared_url | F.coalesce(gap_hours <= 3, F.lit(False))
    row = lambda a, b, c: F.struct(F.lit(a).alias("label"), F.lit(b).alias("score"), F.lit(c).alias("reason"))
    return (
        F.when(forwarded, row("likely_copy", 0.2, "forward_origin"))
        .when(near & signal, row("likely_copy", 0.25, "near_identical_plus_signal"))
        .when(near | shared_url, row("unknown", 0.5, "single_copy_signal"))
        .otherwise(row("independent", 0.85, "paraphrase_or_distinct"))
    )


def independent_counts(members: DataFrame, keys: list[str], label: str, include_unknown: bool = False) -> DataFrame:
    counted = ["independent", "unknown"] if include_unknown else ["independent"]
    return members.groupBy(*keys).agg(F.count(F.lit(1)).alias("observed"), F.count_if(F.col(label).isin(counted)).alias("independent"))


def per_source_label(members: DataFrame, story: str, source: str, label: str) -> DataFrame:
    """The best label of each source in a story: independent before unknown before likely_copy."""
    rank = F.when(F.col(label) == "independent", 2).when(F.col(label) == "unknown", 1).otherwise(0)
    best = members.groupBy(story, source).agg(F.max(rank).alias("r"))
    return best.withColumn(label, F.element_at(F.array(F.lit("likely_copy"), F.lit("unknown"), F.lit("independent")), F.col("r") + 1)).drop("r")


def best_candidate(scored: DataFrame, item: str, score: str, position: str) -> DataFrame:
    rest = [c for c in scored.columns if c != item]
    return scored.groupBy(item).agg(F.min_by(F.struct(*rest), F.struct(-F.col(score), F.col(position))).alias("r")).select(item, *[f"r.{c}" for c in rest])


def evaluate(pairs: DataFrame, slices: list, same: Column, predicted: Column) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1 and the false merge and split rates of each slice, to 4 places."""
    got = pairs.groupBy(*slices).agg(
        F.count_if(same & predicted).alias("tp"), F.count_if(~same & predicted).alias("fp"), F.count_if(~same & ~predicted).alias("tn"), F.count_if(same & ~predicted).alias("fn")
    )
    part = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    return got.withColumns({"precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2 * tp, 2 * tp + fp + fn), "false_merge_rate": part(fp, total), "false_split_rate": part(fn, total)})


def primary_member(members: DataFrame, story: str, has_time: Column, at: Column, trust: Column, size: Column, key: str) -> DataFrame:
    w = W.partitionBy(story).orderBy(F.desc(has_time), at, F.desc(trust), F.desc(size), key)
    return members.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
