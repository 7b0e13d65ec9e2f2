"""Fuzzy ratios on the Indel distance, in Arrow batches.

ratio = 2 * LCS / (len a + len b). The longest common subsequence is computed with bit vectors over whole Python integers,
so a pair costs one step a character. For the best window, those with all windows of a text come from one pass, of many pairs at
a time (see `_strands`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def codes(texts) -> tuple[list[np.ndarray], np.ndarray]:
    """The texts' characters as numbers from 0 without gaps, and the lengths."""
    n = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    flat = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    return np.split(flat, np.cumsum(n)[:-1]) if len(n) else [], n


def lcs_many(codes: list[np.ndarray], n: np.ndarray, x: np.ndarray, y: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """The lengths of the longest common subsequences of texts x[k] and y[k], by bit vectors of many pairs at a time."""
    got = np.zeros(len(x), np.int64)
    x, y = np.where(n[x] <= n[y], x, y), np.where(n[x] <= n[y], y, x)
    words, kinds = (n + 63) // 64, 1 + max((int(c.max()) for c in codes if len(c)), default=0)
    order = np.lexsort((n[y], words[x]))
    at = 0
    while at < len(order):
        w = max(1, int(words[x[order[at]]]))
        k = order[at : at + max(1, most // (w * (kinds + 1)))] if kinds > 256 else order[at : at + (1 << 15)]
        k = k[: max(1, (1 << 20) // w)]
        k = k[words[x[k]] <= w]
        at += len(k)
        left, place = np.unique(x[k], return_inverse=True)
        masks = np.zeros((len(left), kinds + 1, w), np.uint64)  # the last kind stands for what follows the end
        for i, t in enumerate(left):
            bit = np.arange(n[t])
            np.bitwise_or.at(masks[i], (codes[t], bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        right, other = np.unique(y[k], return_inverse=True)
        text = np.full((int(n[right].max(initial=0)), len(right)), kinds, np.int32)
        for i, t in enumerate(right):
            text[: n[t], i] = codes[t]
        s = np.full((w, len(k)), ~np.uint64(0))
        for row in text:
            mask = masks[place, row[other]]
            carry = None
            for v in range(w):
                u = s[v] & mask[:, v]
                added = s[v] + u
                over = added < u
                if carry is not None:
                    added += carry
                    over |= added < carry
                s[v] ^= u
                s[v] |= added
                carry = over.astype(np.uint64) if v + 1 < w else None
        # Bits beyond the text match nothing and stay; only a carry past its end is set where it is already.
        got[k] = 64 * w - np.bitwise_count(s).sum(0, dtype=np.int64)
    return got


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best ratio among the shared words alone and with each side's other words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    if not both:
        return ratio(left, right)
    # Both sides begin with the shared words, which are a subsequence as they stand.
    n, one, two = len(both), len(both) + 1 + len(left), len(both) + 1 + len(right)
    return max(200.0 * (n + 1 + lcs(left, right)) / (one + two), 200.0 * n / (n + one), 200.0 * n / (n + two))


def _strands(pairs: list[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair a, b: the places of b where the strands of their braid start that end below b, and where these end.

    The longest common subsequence of a with b[x:y] is y - x less the strands that start at x or later and end before y
    (semi-local comparison after Tiskin). Cells are combed by anti-diagonals, those of all pairs at once; shorter texts are
    filled up with what matches nothing, which changes no strand that ends within the text.
    """
    m, n = (max(len(p[i]) for p in pairs) for i in (0, 1))
    kind, far = (np.int16, 1 << 14) if m + n < 1 << 14 else (np.int32, 1 << 30)
    flat = np.frombuffer("".join(a[::-1] + b for a, b in pairs).encode("utf-32-le", "surrogatepass"), np.uint32)
    known, flat = np.unique(flat, return_inverse=True)
    flat = flat.astype(np.int16 if len(known) < 1 << 15 else np.int32)
    p, q = np.full((m, len(pairs)), -1, flat.dtype), np.full((n, len(pairs)), -2, flat.dtype)
    at = 0
    for k, (a, b) in enumerate(pairs):
        p[m - len(a) :, k] = flat[at : at + len(a)]
        q[: len(b), k] = flat[at + len(a) : at + len(a) + len(b)]
        at += len(a) + len(b)
    side = np.repeat(np.arange(m, dtype=kind)[:, None], len(pairs), axis=1)
    top = np.repeat(np.arange(m, m + n, dtype=kind)[:, None], len(pairs), axis=1)
    same, kept, both = (np.empty((min(m, n), len(pairs)), t) for t in (bool, kind, kind))
    for d in range(m + n - 1):
        j, k = max(0, d - m + 1), min(n, d + 1)
        low = m - 1 - d
        h, v, e, x, s = side[low + j : low + k], top[j:k], same[: k - j], kept[: k - j], both[: k - j]
        # h and v change places if the characters match or h > v.
        np.equal(p[low + j : low + k], q[j:k], out=e)
        np.add(h, v, out=s)
        np.multiply(e, kind(far), out=x, dtype=kind)
        np.bitwise_or(x, h, out=x)
        np.minimum(x, v, out=h)
        np.subtract(s, h, out=v)
    got = []
    for k, (_, b) in enumerate(pairs):
        starts = top[: len(b), k].astype(np.int64) - m
        ends = np.flatnonzero(starts >= 0)
        got.append((starts[ends], ends))
    return got


def _windows(m: int, n: int, starts: np.ndarray, ends: np.ndarray) -> tuple[int, float]:
    """The longest common subsequence of the whole texts of lengths m <= n, and the best ratio of the shorter text with a
    window of the longer of at most its length."""
    # Of windows of one length m from x on: a strand counts if x <= its start and its end < x + m.
    inside = ends - m < starts
    change = np.bincount(np.maximum(ends[inside] - m + 1, 0), minlength=n + 2) - np.bincount(starts[inside] + 1, minlength=n + 2)
    full = m - np.cumsum(change)[: n - m + 1]
    size = np.arange(1, m)
    first = size - np.cumsum(np.bincount(ends, minlength=n))[: m - 1]
    last = size - np.cumsum(np.bincount(starts, minlength=n)[::-1])[: m - 1]
    parts = 200.0 * np.maximum(first, last) / (m + size)
    return n - len(ends), float(max(200.0 * full.max() / (m + m), parts.max(initial=0.0)))


def windows(pairs: list[tuple[str, str]]) -> list[tuple[int, float]]:
    """For each pair of texts what _windows says; pairs of like lengths are combed together."""
    got: list[tuple[int, float]] = [(0, 0.0 if a or b else 100.0) for a, b in pairs]
    ordered = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    todo = sorted((k for k, (a, _) in enumerate(ordered) if a), key=lambda k: (int(8 * np.log2(len(ordered[k][0]))), len(ordered[k][1])))
    at = 0
    while at < len(todo):
        some = todo[at : at + max(1, min(64, 16384 // len(ordered[todo[at]][0])))]
        at += len(some)
        for k, strands in zip(some, _strands([ordered[k] for k in some])):
            got[k] = _windows(*map(len, ordered[k]), *strands)
    return got


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of the longer of at most its length."""
    return windows([(a, b)])[0][1]


def weighted(a: str, b: str) -> float:
    """The best of the plain ratio and the scaled token and partial ones; partial ones only for very different lengths."""
    return all_scores([(a, b)])[0][0]


def all_scores(pairs: list[tuple[str, str]]) -> list[tuple[float, float, float]]:
    """weighted, token_set and partial of each pair; windows that several of them need are looked for once."""
    words = lambda f, p: tuple(" ".join(sorted(f(t.split()))) for t in p)
    apart = [p for p in pairs if p[0] and p[1] and max(map(len, p)) / min(map(len, p)) >= 1.5]
    wanted = list(dict.fromkeys([*pairs, *(words(f, p) for p in apart for f in (list, set))]))
    known = dict(zip(wanted, windows(wanted)))
    out = []
    for p in pairs:
        (a, b), (common, part), tokens = p, known[p], token_set(*p)
        if not a or not b:
            out.append((0.0, tokens, part))
            continue
        spread = max(len(a), len(b)) / min(len(a), len(b))
        best = 200.0 * common / (len(a) + len(b))
        if spread < 1.5:
            out.append((max(best, 0.95 * token_sort(a, b), 0.95 * tokens), tokens, part))
            continue
        scale = 0.9 if spread < 8 else 0.6
        out.append((max(best, scale * part, 0.95 * scale * max(known[words(f, p)][1] for f in (list, set))), tokens, part))
    return out


def scores(a, b):
    """weighted, token_set and partial of two string columns as a struct of 0..1 to 4 places; 0 where a side is blank."""

    @F.pandas_udf("weighted double, token_set double, partial double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        there = [i for i, (p, q) in enumerate(zip(x, y)) if p and q and p.strip() and q.strip()]
        out = np.zeros((len(x), 3))
        for k in range(0, len(there), 1024):
            some = there[k : k + 1024]
            out[some] = [[round(s / 100, 4) for s in row] for row in all_scores([(x.iloc[i], y.iloc[i]) for i in some])]
        return pd.DataFrame(out, columns=["weighted", "token_set", "partial"])

    return run(a, b)


def score(f, a, b):
    """f of two string columns as 0..1 to 4 places; 0 where a side is blank."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([round(f(p, q) / 100, 4) if p and q and p.strip() and q.strip() else 0.0 for p, q in zip(x, y)])

    return run(a, b)
