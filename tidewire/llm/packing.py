"""Best-fit packing after dominance reduction.

Only the sizes of pieces matter for how they fit together, and there are at most `capacity` sizes. So the plan is made
on the driver from the histogram of sizes, whose length is fixed: first the reduction of Martello and Toth (1990) fixes
small sets that dominate every other way to fill a sequence with the largest piece, then best fit decreasing packs what
is left. Every step works on counts, so it takes the same time for ten pieces as for ten billion. The plan, a list of
(size, ranks -> sequences), is then applied to the numbered pieces in Spark.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cut, dense_rank_offsets, partitions


@dataclass
class Plan:
    """Runs of equal sequences. Each line: size, first rank, sequences, pieces of that size in one sequence, first
    sequence, offset of the first of them."""

    lines: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    reduced: int = 0  # sequences that the reduction fixed


def dominating_set(j: int, left: np.ndarray, capacity: int) -> tuple[int, ...] | None:
    """Sizes that, with one piece of size j, provably make a sequence at least as good as any other with that piece.

    `left` counts the other pieces by size. A set dominates another if the other's pieces can be dealt out so that those
    dealt to one piece of the set are together no larger than it. None: nothing up to three pieces is proven.
    """
    room = capacity - j
    have = np.flatnonzero(left[: room + 1])
    if not len(have):
        return ()
    k = int(have[-1])
    least = np.repeat(have[:3], np.minimum(left[have[:3]], 3))[:3]
    if k == room or len(least) < 2 or least[0] + least[1] > room:
        return (k,)  # it fills the rest, or no two pieces fit beside j
    if len(least) == 3 and least.sum() <= room:
        return None  # three pieces may fit: not decided here
    rest = room - k
    second = have[have <= rest]
    if k in second and left[k] < 2:
        second = second[second != k]
    b = int(second[-1]) if len(second) else 0
    for y in have[have > b]:  # every other pair x >= y must fit into k, or deal out over k and b
        x = have[(have >= y) & (have + y <= room) & (have + y > k)]
        if len(x) and not (len(x) == 1 and x[0] == y and left[y] < 2):
            return None
    return (k, b) if b else (k,)


def reduce(left: np.ndarray, capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Fix dominating sets, by falling size, and take their pieces out of `left`, the pieces by size: how many sequences,
    and the (size, pieces) in each. A size for which nothing is proven stays, and so stays a rival of the smaller ones.

    What is fixed never costs a sequence: packing what is left in the fewest gives the fewest of all.
    """
    fixed, size = [], capacity
    while size > 0:
        if not left[size]:
            size -= 1
            continue
        left[size] -= 1
        found = dominating_set(size, left, capacity)
        left[size] += 1
        if found is None:
            size -= 1
            continue
        need: dict[int, int] = {size: 1}
        for s in found:
            need[s] = need.get(s, 0) + 1
        # The same set dominates again as long as its members last: fewer other pieces leave fewer rivals.
        times = min(int(left[s]) // c for s, c in need.items())
        for s, c in need.items():
            left[s] -= c * times
        fixed.append((times, tuple(sorted(need.items(), reverse=True))))
    return fixed


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Pack `histogram` (pieces by size, sizes 1 to capacity)."""
    left = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        left[s] = n
    fixed = reduce(left, capacity)
    plan = Plan(reduced=sum(n for n, _ in fixed))
    # Best fit decreasing over counts: open sequences by their room, each group with one content.
    open_: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room, n, content):
        if room not in open_:
            bisect.insort(rooms, room)
        open_.setdefault(room, []).append((n, content))

    for n, content in fixed:  # what room they leave is open to best fit too
        put(capacity - sum(s * c for s, c in content), n, content)
    for s in np.flatnonzero(left)[::-1].tolist():
        n = int(left[s])
        while n:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                m, content = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, m, content = capacity, -(-n // (capacity // s)), ()
            each = room // s
            full = min(m, n // each)
            n -= full * each
            if full:
                put(room - each * s, full, content + ((s, each),))
            if full < m:
                if n and n < each:
                    put(room - n * s, 1, content + ((s, n),))
                    n, full = 0, full + 1
                if full < m:
                    put(room, m - full, content)
    runs = [(n, content) for groups in open_.values() for n, content in groups]
    ranks: dict[int, int] = {}
    for n, content in runs:
        offset = 0
        for s, c in content:
            plan.lines.append((s, ranks.get(s, 0), n, c, plan.sequences, offset))
            ranks[s] = ranks.get(s, 0) + n * c
            offset += s * c
        plan.sequences += n
    return plan


def pieces(docs: DataFrame, text: str, keep: list[str], encoder: Callable[[], Callable[[str], list[int]]], end: int, capacity: int) -> DataFrame:
    """keep, piece, start, length, ids_crc32: the token ids of each whole text with `end` appended, cut only if longer
    than capacity; then the first piece takes the remainder. A null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for b in batches:
            rows, at = [], []
            for i, t in enumerate(b["__text"]):
                ids = np.array([*encode(t or ""), end], "<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for p, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((p, x, y - x, zlib.crc32(ids[x:y].tobytes())))
                    at.append(i)
            out = b.drop(columns="__text").iloc[at].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32"])], axis=1)

    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInPandas(run, f"{schema}, piece int, start long, length long, ids_crc32 long")


def place(rows: DataFrame, capacity: int, size: str, order: list[str]) -> DataFrame:
    """rows with sequence_id and offset. `order` are the columns that tell rows of one size apart; rows that agree in all
    of them are interchangeable. An empty table gives an empty one."""
    rows = cut(rows)
    histogram = {r[size]: r["n"] for r in rows.groupBy(size).agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(histogram, capacity)
    ranked = dense_rank_offsets(rows, size, F.xxhash64(*order), order, "__rank", partitions(rows.sparkSession))
    lines = np.array(sorted(plan.lines) or np.zeros((0, 6)), np.int64).reshape(-1, 6)  # at most about capacity^2 / 2 lines
    shared = rows.sparkSession.sparkContext.broadcast(lines)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = shared.value
        starts = lines[:, 0] * (1 << 42) + lines[:, 1]
        for b in batches:
            rank, s = b["__rank"].to_numpy(), b[size].to_numpy()
            at = lines[np.searchsorted(starts, s * (1 << 42) + rank, "right") - 1] if len(b) else lines[:0]
            local = rank - at[:, 1]
            out = b.drop(columns="__rank")
            yield out.assign(sequence_id=at[:, 4] + local // at[:, 3], offset=at[:, 5] + local % at[:, 3] * s)

    return ranked.select(*rows.columns, "__rank").mapInPandas(run, f"{schema}, sequence_id long, offset long")
