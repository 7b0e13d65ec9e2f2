"""Phrase collocation mining from word-id suffix arrays.

Every shard of texts of one language is a sequence of word ids with a separator between pieces. Prefix doubling in numpy
sorts its suffixes by their first words; intervals of the LCP array are the shard's n-grams with their counts. Shards send
the counts packed by parts of the key space, and one exchange adds them up. An n-gram of n words is known by the keys of
its first and its last n - 1 words, so the counts of all parts of a phrase come by joining each level with the one below.

No n-gram can be as frequent as `least` unless both (n - 1)-grams in it are. From three words on, shards therefore send only
n-grams whose two parts are in a bitmap of frequent keys. The bitmap has a fixed size: false hits cost rows, never counts.

Keys are 64-bit hashes. Two words that share one are noticed where they meet, and raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.llm.common import cut, partitions
from tidewire.llm.words import mix, pack, unpack

SHARD_WORDS = 600_000
BITMAP_BITS = 1 << 26
_SEPARATOR = b"\xff"  # a byte that UTF-8 never has
_BREAKS = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_STEP = 1 << 22
_SENT = "part int, level int, lang string, first binary, runs binary, last binary, n binary, words binary"
_FOUND = "level int, lang string, first long, last long, key long, word string, f long"


@dataclass(frozen=True)
class Settings:
    least: int = 10  # occurrences of a candidate
    words: int = 3  # of the longest candidate
    cover: int = 50  # percent: a candidate goes if a longer one that holds it is at least that frequent
    top: int = 2000  # phrases of each language


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = xxhash.xxh3_64_intdigest(word)
        return n


def tokens(text: str | None, numbers: dict) -> np.ndarray:
    """The numbers of a text's words, with separators between (some of them empty) pieces and at the end."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().translate(_BREAKS).replace(_SEPARATOR, b" \xff ") + b" \xff"
    out, at = [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= _STEP else raw.find(b" ", at + _STEP)
        end = len(raw) if end < 0 else end
        got = raw[at:end].split(b" ")
        out.append(np.fromiter((numbers[w] for w in got if w), np.uint64))
        at = end
    return np.concatenate(out)


def joined(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The key of an n-gram from the keys of its first and its last n - 1 words."""
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + mix(last, 1))


def suffixes(ids: np.ndarray, words: int) -> np.ndarray:
    """Places in the order of their first `words` ids at least; what follows an id 0 doesn't count. Prefix doubling."""
    rank, width = ids.astype(np.int64), 1
    while width < words:
        after = np.zeros_like(rank)
        after[:-width] = rank[width:]
        pair = rank * (int(rank.max()) + 1) + after
        pair[ids == 0] = 0
        order = np.argsort(pair)
        sorted_ = pair[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
        if ids[order[0]]:
            rank += 1  # 0 stays the separators' rank
        width *= 2
    return np.argsort(rank)


def common_words(ids: np.ndarray, order: np.ndarray, words: int) -> np.ndarray:
    """The LCP array up to `words`: how many ids before a 0 each suffix shares with the one before it in the order."""
    padded = np.r_[ids, np.zeros(words, ids.dtype)]
    out, on = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    for k in range(words):
        own = padded[order + k]
        on &= (own[1:] == own[:-1]) & (own[1:] != 0)
        out[1:] += on
    return out


def intervals(ids: np.ndarray, own: np.ndarray, levels: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each level: its n-grams, by one place of each, and how often they start at the places in `own`."""
    most = max(levels)
    order = suffixes(ids, most)
    shared = common_words(ids, order, most)
    ends = np.flatnonzero(ids == 0)
    left = (np.r_[ends, len(ids)][np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids)))[order]
    mine = own[order]
    for n in levels:
        whole = left >= n
        at, heads = order[whole], np.flatnonzero(shared[whole] < n)
        if len(heads):
            count = np.add.reduceat(mine[whole].astype(np.int64), heads)
            yield n, at[heads][count > 0], count[count > 0]


def _shards(batches, words: int):
    """(lang, numbers by word, sequence, places that count) of shards. A longer text is cut, with words - 1 of context."""
    held: dict[str, tuple[_Numbers, list, list]] = {}
    size = 0

    def flush():
        for lang, (numbers, seqs, owns) in held.items():
            yield lang, numbers, np.concatenate(seqs), np.concatenate(owns)
        held.clear()

    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            numbers = held.setdefault(lang, (_Numbers(), [], []))[0]
            got = tokens(text, numbers)
            for i in range(0, len(got), SHARD_WORDS):
                numbers, seqs, owns = held.setdefault(lang, (numbers, [], []))
                part = got[i : i + SHARD_WORDS + words - 1]
                seqs.append(np.r_[part, np.uint64(numbers[_SEPARATOR])])
                owns.append(np.arange(len(part) + 1) < SHARD_WORDS)
                size += len(part)
                if size >= SHARD_WORDS:
                    yield from flush()
                    size = 0
    yield from flush()


def _sent(lang, level, parts, first, last, n, words=None):
    """Rows of one level of a shard, by part; n-grams in order of their first key, which is kept once."""
    key = first if last is None else joined(first, last)
    part = (key // np.uint64(-(-(1 << 64) // parts))).astype(np.int64)
    by = np.lexsort((first, part))
    ends = np.searchsorted(part[by], np.arange(parts + 1))
    for r in np.flatnonzero(np.diff(ends)).tolist():
        got = by[ends[r] : ends[r + 1]]
        f = first[got]
        heads = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
        runs = np.diff(np.r_[heads, len(f)])
        held = None if words is None else b" ".join([words[i] for i in got.tolist()])
        yield r, level, lang, f[heads].tobytes(), pack(runs), None if last is None else last[got].tobytes(), pack(n[got]), held


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "level", "lang", "first", "runs", "last", "n", "words"])


def _short(parts: int, words: int):
    """Sends words with their counts and, of two words, all n-grams."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, numbers, seq, own in _shards(batches, words):
            known = np.fromiter(numbers.values(), np.uint64, len(numbers))
            names = list(numbers)
            order = np.argsort(known)
            _one_each(known[order], np.array(names, object)[order])
            ids = np.searchsorted(known[order], seq) + 1
            ids[seq == np.uint64(numbers[_SEPARATOR])] = 0
            rows = []
            for n, at, count in intervals(ids, own, [1, 2]):
                if n == 1:
                    rows += _sent(lang, 1, parts, seq[at], None, count, [names[i] for i in order[ids[at] - 1].tolist()])
                else:
                    rows += _sent(lang, 2, parts, seq[at], seq[at + 1], count)
            yield _frame(rows)

    return send


def _long(parts: int, level: int, bitmap):
    """Sends the n-grams of one level both of whose parts are in the bitmap. Words that are in none of them are taken out
    of the shard before its suffixes are sorted."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for lang, numbers, seq, own in _shards(batches, level):
            sep = seq == np.uint64(numbers[_SEPARATOR])
            key, open_ = seq, ~sep
            for n in range(1, level - 1):
                key = joined(key[:-1], key[1:])
                open_ = open_[:-1] & ~sep[n:]
            slot = key % np.uint64(len(bits) * 8)
            open_ &= (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            starts = np.flatnonzero(open_[:-1] & open_[1:])
            if not len(starts):
                continue
            needed = np.zeros(len(seq) + 1, bool)
            for k in range(level):
                needed[starts + k] = True
            kept = np.flatnonzero(needed[:-1])
            gap = np.flatnonzero(np.diff(kept) > 1) + 1
            place = np.insert(kept, gap, -1)  # a separator where something was taken out
            counts = np.zeros(len(seq), bool)
            counts[starts] = True
            counts &= own
            known, ids = np.unique(seq[kept], return_inverse=True)
            ids = np.insert(ids + 1, gap, 0)
            rows = []
            for n, at, count in intervals(np.r_[ids, 0], np.r_[np.where(place < 0, False, counts[place]), False], [level]):
                at = place[at]
                rows += _sent(lang, n, parts, key[at], key[at + 1], count)
            yield _frame(rows)

    return send


def _one_each(keys: np.ndarray, words: np.ndarray) -> None:
    same = keys[1:] == keys[:-1]
    if (words[1:][same] != words[:-1][same]).any():
        raise ValueError("two words share a 64-bit key")


def _merge(least: int):
    """Adds up one part. Of each language: n-grams with `least` occurrences at least, and the number of all words at level 0."""

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (level, lang), own in g.groupby(["level", "lang"], sort=False):
            n = np.concatenate([unpack(x) for x in own["n"]])
            first = np.concatenate([np.repeat(np.frombuffer(f, np.uint64), unpack(r)) for f, r in zip(own["first"], own["runs"])])
            last = first if level == 1 else np.concatenate([np.frombuffer(x, np.uint64) for x in own["last"]])
            key = first if level == 1 else joined(first, last)
            order = np.argsort(key)
            if ((key[order][1:] == key[order][:-1]) & ((first[order][1:] != first[order][:-1]) | (last[order][1:] != last[order][:-1]))).any():
                raise ValueError("two n-grams share a 64-bit key")
            heads = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            f = np.add.reduceat(n[order], heads)
            at, often = order[heads], f >= least
            word = np.full(len(at), None, object)
            if level == 1:
                words = np.array([w for x in own["words"] for w in x.split(b" ")], object)
                _one_each(key[order], words[order])
                word[often] = [w.decode("utf-8", "surrogatepass") for w in words[at[often]]]
                out.append(pd.DataFrame({"level": 0, "lang": lang, "first": 0, "last": 0, "key": 0, "word": None, "f": [int(n.sum())]}))
            got = {"first": first[at], "last": last[at], "key": key[at]}
            got = {k: v[often].view(np.int64) for k, v in got.items()}
            out.append(pd.DataFrame({"level": level, "lang": lang, **got, "word": word[often], "f": f[often]}))
        return pd.concat(out)

    return merge


def frequent(docs: DataFrame, lang: str, text: str, settings: Settings = Settings()) -> DataFrame:
    """level (words), lang, first, last (keys of the first and last level - 1 words; of a word its own), key, word, f: all
    n-grams with `least` occurrences at least. Level 0 holds numbers of words, a row or more for each language."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).head()[0]
    parts = max(partitions(docs.sparkSession), math.ceil(size / (16 << 20)))
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))

    def merged(sent: DataFrame) -> DataFrame:
        return cut(sent.groupBy("part").applyInPandas(_merge(settings.least), _FOUND))

    found = below = merged(rows.mapInPandas(_short(parts, 2), _SENT))
    for level in range(3, settings.words + 1):
        bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(below.where(F.col("level") == level - 1)))
        below = merged(rows.mapInPandas(_long(parts, level, bitmap), _SENT))
        found = found.unionByName(below)
    return found


def _bitmap(grams: DataFrame) -> bytes:
    """BITMAP_BITS bits: those of the keys' remainders are set. The driver gets one row of 64 bits each at most."""
    slot = F.pmod("key", F.lit(BITMAP_BITS))  # a power of two, so signed keys have the same low bits
    got = grams.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(key, {BITMAP_BITS}) & 63 as int))")).alias("bits"))
    rows = got.toPandas()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.tobytes()


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a^2 / (left right)), exact as long as both products have 38 digits at most."""
    a, left, right = (c.cast("decimal(38,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * a * a, left * right)


def annotated(found: DataFrame, settings: Settings) -> list[DataFrame]:
    """Of each level from 1: lang, key, first, last, words, f, and the counts of its 1, 2, ... first and last words."""
    empty = F.array().cast("array<bigint>")
    levels = [
        found.where(F.col("level") == 1).select("lang", "key", "first", "last", F.array("word").alias("words"), "f", empty.alias("starts"), empty.alias("ends"))
    ]
    for n in range(2, settings.words + 1):
        below = levels[-1]
        first = below.select("lang", F.col("key").alias("first"), F.col("words").alias("__w"), F.concat("starts", F.array("f")).alias("starts"))
        last = below.select("lang", F.col("key").alias("last"), F.element_at("words", -1).alias("__l"), F.concat("ends", F.array("f")).alias("ends"))
        own = found.where(F.col("level") == n).select("lang", "key", "first", "last", "f")
        own = own.join(first, ["lang", "first"]).join(last, ["lang", "last"])
        levels.append(own.select("lang", "key", "first", "last", F.concat("__w", F.array("__l")).alias("words"), "f", "starts", "ends"))
    return levels


def collocations(docs: DataFrame, lang: str, text: str, settings: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language.

    Candidates are phrases of 2 to `words` words within a piece that occur `least` times at least; their score is that of
    the cut with the least floor(1,000,000 a^2 / (l r)), of equal ones the first. A candidate that a longer one covers goes.
    Order: score and a falling, phrase rising by bytes. A null language is `und`; null and empty texts have no words;
    repeated rows count each; a language without candidates has no row; an empty table gives an empty one. A piece of any
    length, and a text of any length, counts whole.
    """
    found = frequent(docs, lang, text, settings)
    levels = annotated(found, settings)
    total = found.where(F.col("level") == 0).groupBy("lang").agg(F.sum("f").alias("n"))
    got = []
    for n in range(2, settings.words + 1):
        own = levels[n - 1]
        cuts = [
            F.struct(score(F.col("f"), F.col("starts")[k - 1], F.col("ends")[n - k - 1]).alias("score"), F.lit(k).alias("k"), F.col("starts")[k - 1].alias("l"), F.col("ends")[n - k - 1].alias("r"))
            for k in range(1, n)
        ]
        own = own.withColumn("cut", F.array_min(F.array(*cuts)))
        if n < settings.words:  # a phrase that is still longer is no more frequent than the one of n + 1 words within it
            longer = levels[n].select("lang", F.explode(F.array("first", "last")).alias("key"), F.col("f").alias("__f"))
            longer = longer.groupBy("lang", "key").agg(F.max("__f").alias("__f"))
            own = own.join(longer, ["lang", "key"], "left").where(F.col("__f").isNull() | (100 * F.col("__f") < settings.cover * F.col("f")))
        got.append(own.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"))
    all_ = got[0]
    for more in got[1:]:
        all_ = all_.unionByName(more)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = all_.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(32)))
    for group in (["lang", "__salt"], ["lang"]):
        dealt = dealt.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= settings.top)
    return dealt.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
