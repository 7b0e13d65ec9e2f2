"""Exact n-gram Jaccard self-join by multiple global orders, as classes rather than pairs.

Every text becomes its set of n-gram numbers (64 bits; two sets of a thousand collide with odds below 1e-12). What links
is decided on whole sets. Candidates are narrowed in steps, each of which is safe, so no link is lost:

1. Unique tokens first. In any global order that starts with the tokens of one set only, a set has a candidate only if
   its other tokens alone can reach the threshold. Which tokens are shared is found by one exchange of 4-byte numbers
   packed by blocks of texts; within a partition they can only be taken for shared by mistake, never for unique.
2. Equal sets are one class from here on, and step 1 runs again between the classes.
3. Stars. For several orders, sets with the same first token are compared with the one of them that has the fewest unique
   tokens. Most members of a large group of near copies are joined here, without comparing them with each other, and what
   two sets share with their centre bounds what they share with each other.
4. Prefixes. For each of several orders, classes that lie in different components so far and share a token of the
   prefixes that the overlap which two sets of their sizes need leaves to each are candidates; only pairs that are
   candidates under every order are verified. The components of all links found are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import words
from tidewire.llm.common import cut, meet, partitions, small
from tidewire.llm.components import components
from tidewire.llm.words import pack, unpack

NONE = -(1 << 63)  # stands for a null key
BLOCK_TOKENS = 500_000  # of one block; bounds a task's memory


def _sets(batches: Iterator[pd.DataFrame], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """id and set of each row of (id, body): body is a text, of which it is made, or the packed set itself."""
    for b in batches:
        for i, body in zip(b["id"].tolist(), b["body"]):
            raw = isinstance(body, (bytes, bytearray))
            yield i, np.frombuffer(body, np.uint64) if raw else words.shingles(words.numbers(words.split(body, True)), n)


def set_number(s: np.ndarray) -> int:
    """The number of a set of tokens, signed 64 bits."""
    h = int(words.mix(s, 7).sum(dtype=np.uint64)) if len(s) else 0
    h ^= len(s) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def token_sets(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """id, set_hash, tokens: each whole text's set as packed sorted 64-bit numbers, words lower-cased in A-Z."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, sets in _blocks(_sets(batches, n)):
            yield pd.DataFrame({"id": ids, "set_hash": [set_number(s) for s in sets], "tokens": [s.tobytes() for s in sets]})

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("body"))
    return rows.mapInPandas(run, "id long, set_hash long, tokens binary")


def _owners(rows: np.ndarray, of: int) -> bytes:
    """Which of `of` rows each of a cell's tokens belongs to; rows don't fall. Either how many tokens each row has or the
    steps from row to row, whichever is shorter, so a cell costs no more than its tokens do."""
    if of <= len(rows):
        counts = np.bincount(rows, minlength=of)
        return b"c" + pack(counts)
    return b"s" + pack(np.diff(rows, prepend=0))


def _owned(raw: bytes) -> np.ndarray:
    x = unpack(raw[1:])
    return np.repeat(np.arange(len(x)), x) if raw[:1] == b"c" else np.cumsum(x)


def _blocks(rows: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows collected until they hold BLOCK_TOKENS tokens."""
    ids, sets, held = [], [], 0
    for i, s in rows:
        if sets and held + len(s) > BLOCK_TOKENS:
            yield ids, sets
            ids, sets, held = [], [], 0
        ids.append(i)
        sets.append(s)
        held += len(s)
    if sets:
        yield ids, sets


def shared_tokens(rows: DataFrame, parts: int, bits: bool, n: int = 0) -> DataFrame:
    """Of rows (id, body), body a text or a packed set: id, set_hash, n, shared (how many tokens other rows have too) and,
    if asked for, their bits over the sorted set.

    A block of rows sends to each partition of the token space its distinct numbers, once each whatever their number of
    rows, and gets back which of those that only one row of the block has are known to other blocks.
    """
    width = -(-(1 << 64) // parts)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for count, (ids, sets) in enumerate(_blocks(_sets(batches, n))):
            block = task << 32 | count
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
            order = np.argsort(flat, kind="stable")
            same = np.zeros(len(flat), bool)
            same[1:] = flat[order][1:] == flat[order][:-1]
            twice = same.copy()
            twice[:-1] |= same[1:]
            local = np.empty(len(flat), bool)
            local[order] = twice
            known = flat[order][twice & ~same]
            head = pd.DataFrame({"id": np.array(ids, np.int64), "h": np.array([set_number(s) for s in sets], np.int64), "n": sizes})
            part = (flat // np.uint64(width)).astype(np.int32)
            kpart = (known // np.uint64(width)).astype(np.int32)
            cells = np.argsort(part, kind="stable")  # by partition, then row, then token
            ends = np.searchsorted(part[cells], np.arange(parts + 1))
            kends = np.searchsorted(kpart, np.arange(parts + 1))
            home = block % parts
            out = []
            for r in range(parts):
                at = cells[ends[r] : ends[r + 1]]
                k = known[kends[r] : kends[r + 1]]
                if not len(at) and r != home:
                    continue
                low = lambda x: x.astype(np.uint32).tobytes()
                out.append((r, block, low(flat[at][~local[at]]), low(k), _owners(owner[at], len(sets)), np.packbits(local[at]).tobytes(), head.to_records(index=False).tolist() if r == home else None))
            yield pd.DataFrame(out, columns=["part", "block", "single", "several", "owners", "local", "head"])

    entry = "part int, block long, single binary, several binary, owners binary, local binary, head array<struct<id: bigint, h: bigint, n: bigint>>"

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        single = [np.frombuffer(x, np.uint32) for x in g["single"]]
        several = [np.frombuffer(x, np.uint32) for x in g["several"]]
        everything = np.concatenate([*single, *several])
        order = np.argsort(everything, kind="stable")
        s = everything[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        twice = same.copy()
        twice[:-1] |= same[1:]
        flag = np.empty(len(s), bool)
        flag[order] = twice
        masks, owners, at = [], [], 0
        for x, raw, owned in zip(single, g["local"], g["owners"]):
            got = flag[at : at + len(x)]
            at += len(x)
            total = len(raw) * 8
            local = np.unpackbits(np.frombuffer(raw, np.uint8), count=total).astype(bool)
            rows = np.flatnonzero(~local)[: len(x)]
            local[rows] = got
            if bits:
                masks.append(np.packbits(local).tobytes())
                owners.append(owned)
            else:  # only how many of each row's tokens are shared
                owner = _owned(owned)
                of, count = np.unique(owner[local[: len(owner)]], return_counts=True)
                owners.append(pack(np.diff(of, prepend=0)))
                masks.append(pack(count))
        out = pd.DataFrame({"part": g["part"], "block": g["block"], "owners": owners, "mask": masks, "head": g["head"]})
        return out if bits else out[out["head"].notna() | (out["mask"].map(len) > 1)]

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part", ignore_index=True)
        head = pd.DataFrame([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in next(h for h in g["head"] if h is not None)], columns=["id", "set_hash", "n"])
        rows = len(head)
        found, pieces = np.zeros(rows, np.int64), []
        for raw, mask in zip(g["owners"], g["mask"]):
            if not bits:
                found[np.cumsum(unpack(raw))] += unpack(mask)
                continue
            owner = _owned(raw)
            m = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(owner))
            found += np.bincount(owner, weights=m, minlength=rows).astype(np.int64)
            if bits:
                pieces.append((owner, m))
        out = head.assign(shared=found)
        if bits:
            owner = np.concatenate([o for o, _ in pieces] or [np.zeros(0, int)])
            m = np.concatenate([x for _, x in pieces] or [np.zeros(0, np.uint8)])[np.argsort(owner, kind="stable")]
            ends = np.concatenate([[0], np.cumsum(head["n"].to_numpy())])
            out["bits"] = [np.packbits(m[a:b]).tobytes() for a, b in zip(ends, ends[1:])]
        return out

    sent = rows.mapInPandas(send, entry)
    answers = sent.groupBy("part").applyInPandas(answer, "part int, block long, owners binary, mask binary, head array<struct<id: bigint, h: bigint, n: bigint>>")
    return answers.groupBy("block").applyInPandas(merge, "id long, set_hash long, n long, shared long" + ", bits binary" * bits)


def _least_overlap(n: Column, num: int) -> Column:
    return F.ceil(n * num / 100).cast("long")


def classes(docs: DataFrame, key: str, text: str, n: int = 5, percent: int = 80, orders: int = 3) -> DataFrame:
    """doc, n_tokens, class_id, component: one row for each row of docs.

    Two rows link when 100 * |A and B| >= percent * |A or B| over their sets of word n-grams. class_id is the least key
    with the same set, component the least key reachable by links. Rows without words link with nothing, are a class of
    their own and count 0 tokens. Rows with a null key keep null in both and take no part. Rows that repeat, or share a
    key, are one node. Other columns are ignored.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).head()[0]
    parts = max(partitions(spark), math.ceil(size / (16 << 20)))
    every = cut(shared_tokens(docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NONE)).alias("id"), F.col(text).alias("body")), parts, False, n))
    able = every.where((F.col("id") != NONE) & (F.col("n") > 0) & (F.col("shared") >= _least_overlap(F.col("n"), percent)))
    reps = cut(able.groupBy("set_hash").agg(F.min("id").alias("rep")))
    # The sets of the classes' first texts, and which of their tokens other classes have.
    wanted = small(reps.select(F.col("rep").alias("id"), "set_hash"), 1_000_000)
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("__t")).join(wanted.select("id").distinct(), "id", "left_semi")
    sets = token_sets(own, "id", "__t", n).join(wanted, ["id", "set_hash"], "left_semi")
    sets = cut(sets.groupBy("set_hash").agg(F.first("tokens").alias("tokens")))
    marked = shared_tokens(sets.select(F.col("set_hash").alias("id"), F.col("tokens").alias("body")), parts, True)
    marked = marked.where(F.col("shared") >= _least_overlap(F.col("n"), percent)).select("id", "n", "shared", "bits")
    near = cut(marked.join(sets.withColumnRenamed("set_hash", "id"), "id").select("id", "n", "shared", "tokens", "bits"))
    links = _links(near, percent, orders)
    for side in ("a", "b"):
        links = links.join(reps.select(F.col("set_hash").alias(side), F.col("rep").alias(f"{side}_rep")), side)
    # A key with several sets is one node: it is linked to the first key of each.
    several = every.where(F.col("id") != NONE).groupBy("id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).where("lo < hi")
    several = small(cut(several.select("id")), 1_000_000)
    shared = every.join(several, "id", "left_semi").join(reps, "set_hash").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    joined = cut(components(links.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).unionByName(shared)))
    root = reps.join(joined, F.col("rep") == F.col("node"), "left").select("set_hash", "rep", F.coalesce("component", "rep").alias("by_set"))
    by_key = small(joined.join(several, F.col("node") == F.col("id"), "left_semi").select(F.col("node").alias("id"), F.col("component").alias("by_key")), 1_000_000)
    at = meet(every, root, ["set_hash"], how="left")
    at = at.join(by_key, "id", "left")
    own_id = F.nullif(F.col("id"), F.lit(NONE))
    pick = lambda *c: F.when(own_id.isNotNull(), F.coalesce(*c, "id"))
    return at.select(own_id.alias(key), F.col("n").alias("n_tokens"), pick("rep").alias("class_id"), pick("by_key", "by_set").alias("component"))


def _prefixes(near: DataFrame, percent: int, orders: int) -> DataFrame:
    """id, n, shared, prefixes: of each order, a set's longest prefix among its shared tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw, mask, n in zip(b["tokens"], b["bits"], b["n"]):
                t = np.frombuffer(raw, np.uint64)
                t = t[np.unpackbits(np.frombuffer(mask, np.uint8), count=len(t)).astype(bool)]
                take = len(t) - -(-n * percent // 100) + 1
                out.append([t[np.argsort(words.mix(t, k + 1), kind="stable")[:take]].astype(np.int64).tolist() for k in range(orders)])
            yield b[["id", "n", "shared"]].assign(prefixes=out)

    return near.mapInPandas(run, "id long, n long, shared long, prefixes array<array<long>>")


def _compared(pairs: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """a, b, both (tokens in common) and linked of pairs, from their whole sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shared, linked = [], []
            for x, y in zip(b["x"], b["y"]):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                shared.append(inter)
                linked.append(100 * inter >= percent * (len(both) - inter))
            yield b[["a", "b"]].assign(both=shared, linked=linked)

    x, y = near.select(F.col("id").alias("a"), F.col("tokens").alias("x")), near.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    both = meet(meet(pairs, x, ["a"]), y, ["b"], pairs)
    return both.select("a", "b", "x", "y").mapInPandas(run, "a long, b long, both long, linked boolean")


def _links(near: DataFrame, percent: int, orders: int) -> DataFrame:
    """Edges that connect exactly what the links between the sets of near connect."""
    spent = percent / (100 + percent)
    sets = cut(_prefixes(near, percent, orders))
    first = sets.select("id", "n", "shared", F.posexplode("prefixes").alias("k", "p")).select("k", "id", "n", "shared", F.col("p")[0].alias("token"))
    centre = first.groupBy("k", "token").agg(F.min_by("id", F.struct(-F.col("shared") / F.col("n"), "id")).alias("c"))
    star = cut(meet(first, centre, ["k", "token"]).select("k", "id", "c"))
    pairs = cut(star.where("id <> c").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct())
    stars = cut(_compared(pairs, near, percent))
    found = stars.where("linked").select("a", "b")
    comp = components(found)
    # Each set with its component so far and, for each order, its centre and the tokens that it shares with that.
    spoke = star.withColumns({"a": F.least("id", "c"), "b": F.greatest("id", "c")}).join(stars.select("a", "b", "both"), ["a", "b"], "left")
    spoke = spoke.groupBy(F.col("id").alias("s")).agg(F.array_sort(F.collect_list(F.struct("k", "c", "both"))).alias("centres"))
    known = sets.join(comp, F.col("id") == F.col("node"), "left").join(spoke, F.col("id") == F.col("s"))
    known = cut(known.select("id", "n", "shared", F.coalesce("component", "id").alias("comp"), "centres", "prefixes"))
    light = known.select("id", "comp", F.posexplode(F.col("prefixes")[0]).alias("place", "token"))
    mixed = light.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    light = meet(light, mixed, ["token"]).select("id", "place", "token")
    rows = cut(light.join(known, "id").select("id", "n", "shared", "comp", "centres", "place", "token", F.slice(F.col("prefixes")[0], F.lit(1), F.col("place")).alias("before")))
    other = rows.select("token", *[F.col(c).alias(c + "2") for c in rows.columns if c != "token"])
    # Two sets that share `need` tokens share one of the first shared - need + 1 of each, in any common order. Of two sets
    # with one centre, what they share is no more than what the lesser shares with the centre and what the lesser has
    # besides. A pair meets at its first common token only.
    need = F.ceil((F.col("n") + F.col("n2")) * F.lit(spent) - 1e-9)
    apart = F.lit(False)
    for k in range(orders):
        x, y = F.col("centres")[k], F.col("centres2")[k]
        i, j = F.coalesce(x["both"], "shared"), F.coalesce(y["both"], "shared2")  # the centre itself has no spoke
        apart = apart | ((x["c"] == y["c"]) & (F.least(i, j) + F.least(F.col("shared") - i, F.col("shared2") - j) < need))
    on = (
        (F.col("id") < F.col("id2")) & (F.col("comp") != F.col("comp2"))
        & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent)
        & (F.col("place") <= F.col("shared") - need) & (F.col("place2") <= F.col("shared2") - need) & ~apart & ~F.arrays_overlap("before", "before2")
    )
    met = meet(rows, other, ["token"]).where(on).select(F.col("id").alias("a"), F.col("id2").alias("b"), need.alias("need"))
    both = met.join(known.select(F.col("id").alias("a"), F.col("shared").alias("m"), F.col("prefixes").alias("p")), "a")
    both = both.join(known.select(F.col("id").alias("b"), F.col("shared").alias("m2"), F.col("prefixes").alias("p2")), "b")
    upto = lambda q, m, k: F.slice(F.col(q)[k], F.lit(1), F.greatest(F.col(m) - F.col("need") + 1, F.lit(0)).cast("int"))
    for k in range(1, orders):
        both = both.where(F.arrays_overlap(upto("p", "m", k), upto("p2", "m2", k)))
    more = _compared(cut(both.select("a", "b")), near, percent)
    return found.unionByName(more.where("linked").select("a", "b"))
