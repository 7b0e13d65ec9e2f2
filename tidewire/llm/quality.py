"""Document quality by a linear-chain conditional random field over lines.

Each line that isn't blank is good or bad. Its features are shares of kinds of characters and words, each put into one of
some intervals, its own and those of the lines beside it; neighbouring labels weigh on each other. A document's quality is
the mean of its lines' marginal probabilities of being good, weighted by their lengths, and its score the probability of
a good label that goes with that quality.

Training is bounded: `documents` labelled documents of either label, `window` lines in a row of each. Lines get their
document's label at first; then lines of bad documents that look good are called good, as long as they are less than half
of the document. Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import apart

_UNIT = 1 << 18  # characters that are counted at once; longer lines are summed over units
#: Upper ends of the intervals of each feature.
EDGES = [
    np.array(e)
    for e in (
        [0.3, 0.5, 0.65, 0.75, 0.85, 0.92, 0.97],  # letters among characters other than white space
        [0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.9],  # capitals among letters
        [0.001, 0.02, 0.05, 0.1, 0.2, 0.4],  # digits
        [0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4],  # other symbols
        [0.005, 0.015, 0.03, 0.06, 0.1, 0.2],  # punctuation
        [0.01, 0.05, 0.1, 0.2, 0.4, 0.7],  # words like the one before
        [0.01, 0.05, 0.15, 0.3, 0.6, 0.9],  # words that end with a symbol
        [1.5, 2.5, 4.5, 8.5, 16.5, 32.5, 64.5, 256.5],  # words
        [2, 3, 4, 5, 6, 8, 12, 30],  # characters of a word
        [0.5, 1.5, 4.5],  # other lines of the document that are alike
    )
]
_BINS = 10
_COLUMNS = len(EDGES) * _BINS
_KINDS: np.ndarray | None = None


@dataclass(frozen=True)
class Settings:
    documents: int = 3000  # of either label, in training
    window: int = 64  # lines of each
    steps: int = 120
    rate: float = 0.1
    ridge: float = 1e-4


@dataclass
class Model:
    weights: np.ndarray  # 3 x _COLUMNS + 1: the line before, the line, the line after, and the constant
    moves: np.ndarray  # 2 x 2: from the label before
    slope: float
    shift: float
    blank: float  # the score of a document without lines


def _kinds() -> np.ndarray:
    """Of each code point: 0 white space, 1 small or other letter, 2 capital, 3 digit, 4 punctuation, 5 other."""
    global _KINDS
    if _KINDS is None:
        kind = np.full(0x110000, 5, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isspace():
                kind[i] = 0
            elif c.isalpha():
                kind[i] = 2 if c.isupper() else 1
            elif c.isdigit():
                kind[i] = 3
        kind[[ord(c) for c in ".,;:!?'\"-()’“”–—،؟"]] = 4
        _KINDS = kind
    return _KINDS


def _sums(units: list[str]) -> np.ndarray:
    """Of each unit: characters other than white space, letters, capitals, digits, symbols, punctuation, words, words like
    the one before, words that end with a symbol. Units aren't empty."""
    code = np.frombuffer("\n".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[code]
    size = np.array([len(u) for u in units])
    start = np.cumsum(size + 1) - size - 1
    per = lambda mask: np.add.reduceat(mask.astype(np.int64), start)
    word = kind != 0
    heads = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    ends = np.flatnonzero(word & ~np.r_[word[1:], False])
    owner = np.searchsorted(start, heads, "right") - 1
    if len(heads):
        before = np.maximum.accumulate(np.where(word & ~np.r_[False, word[:-1]], np.arange(len(code)), 0))
        place = np.arange(len(code)) - before
        mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed[~word] = 0
        number = np.add.reduceat(mixed, heads)
        like = np.r_[False, (number[1:] == number[:-1]) & (owner[1:] == owner[:-1])]
        tail = kind[ends] == 5
    else:
        like = tail = np.zeros(0, bool)
    count = lambda w=None: np.bincount(owner, w, minlength=len(units)).astype(np.int64)
    return np.stack([per(word), per((kind == 1) | (kind == 2)), per(kind == 2), per(kind == 3), per(kind == 5), per(kind == 4), count(), count(like), count(tail)], 1)


def lines(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All lines that aren't blank: the text each is of, its features' intervals and its length without white space."""
    owner, units, of, names = [], [], [], []
    sums, held = [], 0

    def count():
        if units:
            sums.append(_sums(units))
            units.clear()

    for i, text in enumerate(texts):
        for line in (text or "").split("\n"):
            line = line.strip()
            if not line:
                continue
            names.append(xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")))
            for at in range(0, len(line), _UNIT):
                unit = line[at : at + _UNIT]
                units.append(unit)
                of.append(len(owner))
                held += len(unit)
                if held > 4 * _UNIT:
                    count()
                    held = 0
            owner.append(i)
    count()
    owner = np.array(owner, np.int64)
    if not len(owner):
        return owner, np.zeros((0, len(EDGES)), np.uint8), owner
    s = np.zeros((len(owner), 9), np.int64)
    np.add.at(s, np.array(of), np.concatenate(sums))
    _, group, n = np.unique(np.stack([owner.astype(np.uint64), np.array(names, np.uint64)], 1), axis=0, return_inverse=True, return_counts=True)
    alike = n[group.ravel()] - 1
    share = lambda a, b: a / np.maximum(b, 1)
    x = [share(s[:, 1], s[:, 0]), share(s[:, 2], s[:, 1]), share(s[:, 3], s[:, 0]), share(s[:, 4], s[:, 0]), share(s[:, 5], s[:, 0]), share(s[:, 7], s[:, 6]), share(s[:, 8], s[:, 6]), s[:, 6], share(s[:, 0], s[:, 6]), alike]
    return owner, np.stack([np.searchsorted(e, v) for e, v in zip(EDGES, x)], 1).astype(np.uint8), s[:, 0]


def columns(bins: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Indices of the weights of each line, its own and its neighbours'; the last weight but one is nobody's."""
    own = bins + np.arange(len(EDGES)) * _BINS
    none = 3 * _COLUMNS + 1
    before = np.where(first[:, None], none, np.roll(own, 1, 0))
    after = np.where(last[:, None], none, np.roll(own, -1, 0) + 2 * _COLUMNS)
    return np.concatenate([before, own + _COLUMNS, after, np.full((len(bins), 1), 3 * _COLUMNS)], 1)


def _scan(m: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Products of each 2 x 2 matrix (by entry: 00, 01, 10, 11) with those before it, back over `width` at least; each is
    scaled by its largest entry."""
    w = 1
    while True:
        top = np.maximum(np.maximum(m[0], m[1]), np.maximum(m[2], m[3]))
        m = [x / top for x in m]
        if w >= width:
            return m
        (a, b, c, d), (e, f, g, h) = ([x[:-w] for x in m], [x[w:] for x in m])
        m = [np.r_[x[:w], y] for x, y in zip(m, (a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h))]
        w *= 2


def marginals(score: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once. The probability that each line is good, and those of the label before
    and its own (00, 01, 10, 11; of a first line none). At a chain's ends the matrices forget what is beyond."""
    longest = int(np.diff(np.r_[np.flatnonzero(first), len(score)]).max())
    seen = [np.exp(np.minimum(-score, 0)), np.exp(np.minimum(score, 0))]
    step = np.exp(moves - moves.max())
    alpha = _scan([np.where(first, 1.0, step[i, j]) * seen[j] for i in (0, 1) for j in (0, 1)], longest)[:2]
    after = [np.roll(x, -1) for x in seen]
    back = [np.where(last, 1.0, step[i, j] * after[j])[::-1] for j in (0, 1) for i in (0, 1)]  # transposed, from the end
    beta = [x[::-1] for x in _scan(back, longest)[:2]]
    bad, good = alpha[0] * beta[0], alpha[1] * beta[1]
    pair = np.stack([np.roll(alpha[i], 1) * step[i, j] * seen[j] * beta[j] for i in (0, 1) for j in (0, 1)])
    pair[:, first] = 0
    total = pair.sum(0)
    return good / (bad + good), pair / np.where(total == 0, 1, total)


def _train(at: np.ndarray, label: np.ndarray, first: np.ndarray, last: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves of the largest likelihood: Adam over all chains."""
    size = 3 * _COLUMNS + 2
    told = np.bincount(at.ravel(), np.repeat(label, at.shape[1]), size)
    pairs = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(pairs, (label[inner - 1].astype(int), label[inner].astype(int)), 1)
    x, m, v = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    for k in range(1, s.steps + 1):
        p, pair = marginals(x[at].sum(1), x[size:].reshape(2, 2), first, last)
        g = np.r_[told - np.bincount(at.ravel(), np.repeat(p, at.shape[1]), size), pairs.ravel() - pair.sum(1)] / len(at) - s.ridge * x
        g[size - 1] = 0
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x += s.rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return x[:size], x[size:].reshape(2, 2)


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def _means(p: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, p * weight, n) / np.maximum(np.bincount(owner, weight, n), 1)


def _ends(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = owner[1:] != owner[:-1]
    return np.r_[True, change][: len(owner)], np.r_[change, True][: len(owner)]


def fit(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, settings: Settings = Settings()) -> Model:
    """Learn from the documents that `labels` calls 1 or 0. Other labels, and keys with both, don't count. Of documents that
    share a key one is taken. With one label or none at hand, every document gets the share of good ones (none: 0.5)."""
    told = labels.where(F.col(label).isin(0, 1) & F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("__k")).agg(F.min(label).alias("__y"), F.max(label).alias("__z")).where("__y = __z")
    drawn = None
    for y in (0, 1):  # those with the least hashes
        some = told.where(F.col("__y") == y).orderBy(F.xxhash64("__k"), "__k").limit(settings.documents)
        drawn = some if drawn is None else drawn.unionByName(some)
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("__text")).join(F.broadcast(drawn.select("__k", "__y")), "__k")
    rows = rows.groupBy("__k", "__y").agg(F.min_by("__text", F.struct(F.xxhash64("__text"), F.octet_length("__text"))).alias("__text"))
    window = settings.window

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.iloc[i : i + 64]
                owner, bins, weight = lines(part["__text"].tolist())
                cut = np.searchsorted(owner, np.arange(len(part) + 1))
                out = []
                for y, h, a, z in zip(part["__y"], part["__h"], cut, cut[1:]):
                    a += h % max(1, z - a - window + 1)
                    z = min(z, a + window)
                    out.append((h, y, bins[a:z].tobytes(), weight[a:z].tobytes()))
                yield pd.DataFrame(out, columns=["h", "y", "bins", "weight"])

    seen = rows.select("__y", "__text", F.pmod(F.xxhash64("__k"), F.lit(1 << 40)).alias("__h")).mapInPandas(count, "h long, y int, bins binary, weight binary").toPandas().sort_values(["h", "y"], ignore_index=True)
    share = float(seen["y"].mean()) if len(seen) else 0.5
    blank = seen[seen["weight"].map(len) == 0]
    none = Model(np.zeros(3 * _COLUMNS + 2), np.zeros((2, 2)), 0.0, float(_logit(np.array(share))), float((blank["y"].sum() + share) / (len(blank) + 1)))
    seen = seen[seen["weight"].map(len) > 0]
    if seen["y"].nunique() < 2:
        return none
    weight = np.concatenate([np.frombuffer(x, np.int64) for x in seen["weight"]])
    bins = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, len(EDGES)) for x in seen["bins"]])
    y = seen["y"].to_numpy()
    owner = np.repeat(np.arange(len(seen)), seen["weight"].map(len).to_numpy() // 8)
    first, last = _ends(owner)
    at = columns(bins, first, last)
    label_of = y[owner].astype(float)
    weights, moves = _train(at, label_of, first, last, settings)
    own = 1 / (1 + np.exp(-weights[at].sum(1)))  # without the neighbours' labels
    fine = (y[owner] == 0) & (own > 0.5)
    fine &= (2 * np.bincount(owner, weight * fine, len(y)) < np.bincount(owner, weight, len(y)))[owner]
    if fine.any():
        label_of[fine] = 1
        weights, moves = _train(at, label_of, first, last, settings)
    p, _ = marginals(weights[at].sum(1), moves, first, last)
    slope, shift = _line(_logit(_means(p, weight, owner, len(y))), y, share)
    return Model(weights, moves, slope, shift, none.blank)


def _line(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope (not negative) and shift of the logistic curve of y over x, by Newton's steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([(x * (y - p)).sum() - 0.1 * (a - 1), (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -1, 1)
    return float(max(a, 0.0)), float(b)


def qualities(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each text its quality (NaN without lines), its score and its lines' probabilities."""
    owner, bins, weight = lines(texts)
    quality = np.full(len(texts), np.nan)
    score = np.full(len(texts), model.blank)
    if not len(owner):
        return quality, score, [np.zeros(0)] * len(texts)
    first, last = _ends(owner)
    p, _ = marginals(model.weights[columns(bins, first, last)].sum(1), model.moves, first, last)
    some = np.unique(owner)
    quality[some] = np.clip(_means(p, weight, owner, len(texts))[some], 0, 1)
    score[some] = 1 / (1 + np.exp(-np.clip(model.slope * _logit(quality[some]) + model.shift, -30, 30)))
    return quality, score, np.split(p, np.searchsorted(owner, np.arange(1, len(texts))))


def assess(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """docs' columns `keep` and score (0 to 1), quality (null without lines) and lines, the probability that each line that
    isn't blank is good. Columns of these names in `keep` are not allowed (ValueError).

    A null text, an empty one and one of white space have no lines; their score is what training documents without lines
    suggest, and without such the share of good ones. Repeated rows get equal values; whole texts of any length are read.
    """
    apart(keep, ["score", "quality", "lines"])
    rows = docs.select(*keep, F.col(text).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                quality, score, each = qualities(part["__text"].tolist(), shared.value)
                quality = pd.Series(quality, part.index).astype(object).where(~np.isnan(quality), None)
                yield part.drop(columns="__text").assign(score=score, quality=quality, lines=pd.Series(each, part.index))

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return rows.mapInPandas(run, ", ".join([*kinds, "score double, quality double, lines array<double>"]))
