"""Substring dedup on the de Bruijn graph of word k-mers.

Each window of k words is an edge from its first k - 1 words to its last, named by a 64-bit number. A text is a walk over
the graph. An edge repeats a text when it also starts in a text with a smaller key. Where an edge first starts is found by
one exchange of edge names, packed by blocks of texts: a block sends the edges of each text that is the earliest with them
in the block, and settles the others itself, so the texts that send one edge are no more than the blocks. Steps of a walk that go on along the same earlier text are
nonbranching and compact into one path with the coordinates of both ends: the spans. The coordinates of an edge are those
of one start in its least text.

Two different windows share a number with odds of 2^-64. A path of several steps has to agree at each of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import words
from tidewire.llm.common import apart, partitions
from tidewire.llm.words import pack, unpack

BLOCK_WINDOWS = 350_000
LAST = (1 << 63) - 1  # stands for a null key: later than every other
_SPANS = "start binary, steps binary, source binary, source_start binary"


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _blocks(batches, k):
    """(doc, mark, edges) of texts with an edge, collected until they hold BLOCK_WINDOWS of them."""
    out, held = [], 0
    for b in batches:
        for doc, mark, text in zip(b["doc"].tolist(), b["mark"].tolist(), b["text"]):
            e = words.grams(words.numbers(words.split(text)), k)
            if not len(e):
                continue
            if out and held + len(e) > BLOCK_WINDOWS:
                yield out
                out, held = [], 0
            out.append((doc, mark, e))
            held += len(e)
    if out:
        yield out


def _rises(x: np.ndarray) -> bytes:
    """Rising whole numbers as the first one and the steps."""
    return x[:1].astype("<i8").tobytes() + pack(np.diff(x)) if len(x) else b""


def _risen(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    return np.cumsum(np.r_[np.frombuffer(raw, "<i8", 1), unpack(raw[8:])])


def paths(at, source, source_at, owner=None) -> tuple[np.ndarray, ...]:
    """Nonbranching paths of edges in order of place, and of owner, if given: the index of the first edge of each, the
    first place, the number of edges, the source and the place there."""
    if not len(at):
        return np.zeros(0, np.int64), at, at, source, source_at
    on = (np.diff(at) == 1) & (np.diff(source) == 0) & (np.diff(source_at) == 1)
    if owner is not None:
        on &= np.diff(owner) == 0
    first = np.flatnonzero(np.r_[True, ~on])
    return first, at[first], np.diff(np.r_[first, len(at)]), source[first], source_at[first]


def repeated_paths(docs: DataFrame, key: str, text: str, k: int, parts: int) -> DataFrame:
    """doc, mark (of the text) and, packed, the paths of edges that start in an earlier text, with their place there."""
    width = -(-(1 << 64) // parts)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for count, rows in enumerate(_blocks(batches, k)):
            block = task << 32 | count
            rows.sort(key=lambda r: r[0])
            doc = np.array([r[0] for r in rows], np.int64)
            mark = np.array([r[1] for r in rows], np.int64)
            sizes = np.array([len(r[2]) for r in rows], np.int64)
            edge = np.concatenate([r[2] for r in rows])
            rows.clear()
            owner = np.repeat(np.arange(len(doc), dtype=np.int32), sizes)
            at = (np.arange(len(edge)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            order = np.argsort(edge, kind="stable")  # of equal edges, those of the least key come first
            e = edge[order]
            head = np.r_[True, e[1:] != e[:-1]]
            least = order[head]
            source_of = np.empty(len(edge), np.int32)  # the first start of each edge in the block
            source_of[order] = least[np.cumsum(head) - 1]
            later = doc[owner] > doc[owner[source_of]]
            mine = np.flatnonzero(later)
            of = source_of[mine]
            first, start, steps, source, source_start = paths(at[mine], doc[owner[of]], at[of], owner[mine])
            own = _table(owner[mine][first], start, steps, source, source_start)
            part = (edge // np.uint64(width)).astype(np.int32)
            part[later] = parts
            by = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[by], np.arange(parts + 1))
            home, out = block % parts, []
            for r in range(parts):
                got = by[ends[r] : ends[r + 1]]
                if len(got) or r == home:
                    mark_ends = np.flatnonzero(np.r_[True, owner[got][1:] != owner[got][:-1]]) if len(got) else np.zeros(0, int)
                    step = np.diff(at[got], prepend=0)
                    step[mark_ends] = at[got][mark_ends]
                    texts = owner[got][mark_ends].astype(np.int64)
                    n = np.diff(np.r_[mark_ends, len(got)])
                    mine = r == home
                    out.append((r, block, edge[got].tobytes(), _rises(doc[texts]), _rises(texts), pack(n), pack(step), doc.tobytes() if mine else None, mark.tobytes() if mine else None, own if mine else None))
            yield pd.DataFrame(out, columns=["part", "block", "edge", "docs", "texts", "n", "step", "all_docs", "all_marks", "found"])

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        edge = np.concatenate([np.frombuffer(x, np.uint64) for x in g["edge"]])
        doc = np.concatenate([_risen(x) for x in g["docs"]])
        texts = np.concatenate([_risen(x) for x in g["texts"]])
        n = np.concatenate([unpack(x) for x in g["n"]])
        row = np.repeat(np.arange(len(g)), [len(unpack(x)) for x in g["n"]])
        # Places by sums modulo 2^32: differences are right as long as a place itself is below 2^31.
        at = np.cumsum(np.concatenate([unpack(x).astype(np.int32) for x in g["step"]]), dtype=np.int32)
        start = np.cumsum(n) - n
        at -= np.repeat(np.where(start > 0, at[start - 1], 0), n)
        owner = np.repeat(np.arange(len(doc), dtype=np.int32), n)
        mine, of = [], []
        low = edge.view(np.uint8)[::8] & 7  # all starts of an edge have the same low bits, so eighths are sorted one by one
        for eighth in range(8):
            some = np.flatnonzero(low == eighth).astype(np.int32)
            e = edge[some]
            order = np.argsort(e, kind="stable")
            e = e[order]
            same = np.r_[False, e[1:] == e[:-1]][: len(e)]
            twice = same.copy()
            twice[:-1] |= same[1:]
            order = some[order[twice]]  # edges with several starts only
            order = order[np.lexsort((at[order], doc[owner[order]], edge[order]))]
            e = edge[order]
            head = np.r_[True, e[1:] != e[:-1]][: len(e)]
            least = order[head][np.cumsum(head) - 1] if len(e) else order
            later = doc[owner[order]] > doc[owner[least]]
            mine.append(order[later])
            of.append(least[later])
        mine, of = np.concatenate(mine), np.concatenate(of)
        by = np.argsort(mine, kind="stable")  # by block, text and place, as they came
        mine, of = mine[by], of[by]
        cut = np.searchsorted(row[owner[mine]], np.arange(len(g) + 1))
        found = []
        for i, (a, b) in enumerate(zip(cut, cut[1:])):
            m, o = mine[a:b], of[a:b]
            got = [_table(texts[owner[m]], at[m], np.ones(b - a, np.int64), doc[owner[o]], at[o])] if b > a else []
            own = g["found"].iloc[i]
            found.append(b"".join(got) + (own or b""))
        out = g[["block", "all_docs", "all_marks"]].assign(found=found)
        return out[out["all_docs"].notna() | (out["found"].map(len) > 0)]

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        home = g[g["all_docs"].notna()].iloc[0]
        doc, mark = np.frombuffer(home["all_docs"], np.int64), np.frombuffer(home["all_marks"], np.int64)
        got = [t for raw in g["found"] for t in _tables(raw)]
        owner, at, steps, source, source_at = (np.concatenate([t[i] for t in got] or [np.zeros(0, np.int64)]) for i in range(5))
        by = np.lexsort((at, owner))
        owner, at, steps, source, source_at = (x[by] for x in (owner, at, steps, source, source_at))
        on = (owner[1:] == owner[:-1]) & (at[:-1] + steps[:-1] == at[1:]) & (source[1:] == source[:-1]) & (source_at[:-1] + steps[:-1] == source_at[1:])
        first = np.flatnonzero(np.r_[True, ~on][: len(at)])
        steps = np.add.reduceat(steps, first) if len(first) else steps
        owner, at, source, source_at = owner[first], at[first], source[first], source_at[first]
        cut = np.searchsorted(owner, np.arange(len(doc) + 1))
        rows = [(int(doc[i]), int(mark[i]), _rises(at[a:b]), pack(steps[a:b]), source[a:b].tobytes(), pack(source_at[a:b])) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        out = pd.DataFrame(rows, columns=["doc", "mark", "start", "steps", "source", "source_start"])
        return out.astype({"doc": "int64", "mark": "int64"})

    sent = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), _mark(F.col(text)).alias("mark"), F.col(text).alias("text")
    ).mapInPandas(send, "part int, block long, edge binary, docs binary, texts binary, n binary, step binary, all_docs binary, all_marks binary, found binary")
    answers = sent.groupBy("part").applyInPandas(answer, "block long, all_docs binary, all_marks binary, found binary")
    return answers.groupBy("block").applyInPandas(merge, f"doc long, mark long, {_SPANS}")


def _table(owner, at, steps, source, source_at) -> bytes:
    """Five columns of one length as bytes, after the length."""
    columns = [np.asarray(owner, "<i4"), np.asarray(at, "<i4"), np.asarray(steps, "<i4"), np.asarray(source, "<i8"), np.asarray(source_at, "<i4")]
    return np.int64(len(columns[0])).tobytes() + b"".join(c.tobytes() for c in columns)


def _tables(raw: bytes) -> Iterator[list[np.ndarray]]:
    at = 0
    while at < len(raw):
        n = int(np.frombuffer(raw, "<i8", 1, at)[0])
        at += 8
        out = []
        for kind, size in (("<i4", 4), ("<i4", 4), ("<i4", 4), ("<i8", 8), ("<i4", 4)):
            out.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
            at += size * n
        yield out


def dedup(docs: DataFrame, key: str, text: str, keep: list[str], k: int = 50) -> DataFrame:
    """keep, words (all), kept (the words left, joined by one space), removed (how many went) and spans.

    A word goes if a window of k words that covers it also starts in a row with a smaller key; windows are judged on the
    input. spans holds the nonbranching paths: start and length in words, and the earlier text with the place there. A null
    key is later than all others; rows that share a key don't count against each other; a null text has no words.
    A kept column named like an output is an error.
    """
    apart(keep, ["words", "kept", "removed", "spans"])
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).head()[0]
    parts = max(partitions(spark), math.ceil(size / (8 << 20)))
    found = repeated_paths(docs, key, text, k, parts).dropDuplicates(["doc", "mark"])
    found = found.select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), F.struct("start", "steps", "source", "source_start").alias("__found"))
    rest = [c for c in keep if c != text]
    rows = docs.select(*rest, F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("__d"), _mark(F.col(text)).alias("__m"), F.col(text).alias("__text"))

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        zip_ = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield b.assign(__text=[None if t is None else zip_(t.encode("utf-8", "surrogatepass")) for t in b["__text"]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema)
    rows = rows.mapInPandas(shrink, ", ".join(filter(None, [kinds, "__d long, __m long, __text binary"])))
    rows = rows.join(found, (F.col("__d") == F.col("__doc")) & (F.col("__m") == F.col("__mark")), "left").select(*rest, "__text", "__found")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.iloc[i : i + 512]
                texts = [None if t is None else unzip(t).decode("utf-8", "surrogatepass") for t in part["__text"]]
                got = [_without(t, f, k) for t, f in zip(texts, part["__found"])]
                out = part.drop(columns=["__text", "__found"]).reset_index(drop=True)
                out = pd.concat([out, pd.DataFrame(got, columns=["words", "removed", "kept", "spans"])], axis=1)
                yield (out.assign(**{text: texts}) if text in keep else out)[[*keep, "words", "removed", "kept", "spans"]]

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    spans = "array<struct<start: bigint, length: bigint, source: bigint, source_start: bigint>>"
    return rows.mapInPandas(run, ", ".join([*own, f"words long, removed long, kept string, spans {spans}"]))


def _without(text: str | None, found: dict | None, k: int) -> tuple[int, int, str, list[dict]]:
    """Number of words, how many went, the text left and the spans."""
    w = words.split(text)
    if found is None:
        return len(w), 0, b" ".join(w).decode("utf-8", "surrogatepass"), []
    at, steps = _risen(bytes(found["start"])), unpack(bytes(found["steps"]))
    source, source_at = np.frombuffer(bytes(found["source"]), "<i8"), unpack(bytes(found["source_start"]))
    cover = np.zeros(len(w) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + steps + k - 1, -1)
    left = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    spans = [
        {"start": a, "length": n + k - 1, "source": None if s == LAST else s, "source_start": p}
        for a, n, s, p in zip(at.tolist(), steps.tolist(), source.tolist(), source_at.tolist())
    ]
    return len(w), len(w) - len(left), b" ".join([w[i] for i in left]).decode("utf-8", "surrogatepass"), spans
