"""Language identification by nearest centroid.

Texts become L2-normalised TF-IDF vectors of hashed character bigrams and trigrams. Each language has several
centroids, found by spherical k-means over its training texts. A text takes the language of the nearest centroid by
cosine; where even that one is too far for its length, the text is rejected.

Only training is bounded: at most `per_language` labelled texts of each of the `languages` commonest languages are kept.
Prediction reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.llm.common import apart, cut

UNKNOWN = "und"
_STEP = 1 << 21
_LETTER: np.ndarray | None = None


@dataclass(frozen=True)
class Settings:
    dims: int = 4096
    per_language: int = 400
    languages: int = 500  # the commonest ones are learned
    centroids: int = 4
    rounds: int = 12
    reject_share: float = 0.35  # of the least cosine that training texts no shorter reach with their own language


@dataclass
class Model:
    languages: list[str]  # one per centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # least cosine by length class


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points, each run of other characters than letters as one space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _letters()[c]
    c = np.where(ok, c, np.uint32(32))
    return c[ok | np.r_[True, ok[:-1]]] if len(c) else c


def counts(text: str | None, dims: int) -> tuple[np.ndarray, int]:
    """Hashed n-gram counts of the whole text and its number of letters; long texts go in steps, so memory is bounded."""
    out, letters, tail = np.zeros(dims, np.int64), 0, np.array([32], np.uint32)
    for i in range(0, len(text or ""), _STEP):
        c = np.r_[tail, _codes(text[i : i + _STEP])]
        letters += int((c[len(tail) :] != 32).sum())
        for n, gap in ((2, max(0, len(tail) - 2)), (3, 0)):
            if len(c) < n:
                continue
            x = c[gap:]
            h = x[: len(x) - n + 1] * np.uint32(0x9E3779B1)
            for k in range(1, n):
                h = (h ^ x[k : len(x) - n + 1 + k]) * np.uint32(0x85EBCA6B)
            out += np.bincount((h >> np.uint32(16)) & np.uint32(dims - 1), minlength=dims)
        tail = c[-2:]
    return out, letters


def _length_class(letters: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(letters, 1)), 0, 11).astype(int)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _vectors(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit((np.sqrt(c) * idf).astype(np.float32))


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from spread-out rows; deterministic."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = _unit(np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


def bound(n: int, wanted: int) -> int:
    """The greatest 64-bit hash, as a signed number, of a draw of twice `wanted` of n different texts; all, if they are few.
    Twice, so that the `wanted` least hashes are among them although n is an estimate."""
    return (1 << 63) - 1 if n <= 2 * wanted else (2 * wanted << 64) // n - (1 << 63)


def _sample(docs: DataFrame, text: str, lang: str, key: Column, s: Settings) -> DataFrame:
    """lang, h (from 1) and text of at most `per_language` texts of each of the commonest `languages`: those with the least
    hashes of key and text."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("__lang"), F.col(text).alias("__text"), F.xxhash64(key, text).alias("__x")
    )
    common = rows.groupBy("__lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("__x").alias("texts")).orderBy(F.desc("n"), "__lang").limit(s.languages)
    sizes = [(r["__lang"], bound(r["texts"], s.per_language)) for r in common.collect()]
    bounds = docs.sparkSession.createDataFrame(sizes, "__lang string, __bound long")
    drawn = rows.join(F.broadcast(bounds), "__lang").where(F.col("__x") <= F.col("__bound")).dropDuplicates(["__lang", "__x"])
    place = F.row_number().over(W.partitionBy("__lang").orderBy("__x"))
    return drawn.withColumn("h", place).where(F.col("h") <= s.per_language).select(F.col("__lang").alias("lang"), F.col("h").cast("long").alias("h"), "__text")


def _dense(at: pd.Series, n: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(at), dims), np.int32)
    for row, i, k in zip(out, at, n):
        row[np.frombuffer(i, np.int32)] = np.frombuffer(k, np.int32)
    return out


def fit(docs: DataFrame, text: str, lang: str, key: Column, settings: Settings = Settings()) -> Model:
    """Learn from the labelled rows of docs: those with a language and at least one letter.

    A bounded sample is drawn by the hash of `key` and text: at most `per_language` texts of each language; rows that repeat
    both count once. Of more than `languages` languages the commonest are learned, of equally common ones the first in
    alphabetical order. Texts are counted, weighted and clustered on the executors, one language in a task; the driver gets
    the frequencies of n-grams and the centroids.
    """
    dims, s = settings.dims, settings

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, h, t in zip(b["lang"], b["h"], b["__text"]):
                c, letters = counts(t, dims)
                at = np.flatnonzero(c).astype(np.int32)
                out.append((name, h, letters, at.tobytes(), c[at].astype(np.int32).tobytes()))
            yield pd.DataFrame(out, columns=["lang", "h", "letters", "at", "n"])

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, texts = np.zeros(dims, np.int64), 0
        for b in batches:
            texts += len(b)
            for at in b["at"]:
                total[np.frombuffer(at, np.int32)] += 1
        yield pd.DataFrame({"at": np.r_[np.flatnonzero(total), -1], "n": np.r_[total[total > 0], texts]})

    seen = cut(_sample(docs, text, lang, key, s).mapInPandas(vectors, "lang string, h long, letters long, at binary, n binary").where("letters > 0"))
    found = seen.mapInPandas(frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(dims)
    often[found["at"][found["at"] >= 0]] = found["n"][found["at"] >= 0]
    texts = int(found["n"][found["at"] < 0].sum())
    idf = np.log((1 + texts) / (1 + often)) + 1

    def cluster(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("h")
        x = _vectors(_dense(g["at"], g["n"], dims), idf)
        own = _kmeans(x, s.centroids, s.rounds).astype(np.float32)
        size, best = _length_class(g["letters"].to_numpy()), (x @ own.T).max(1)
        least = [float(best[size == i].min()) if (size == i).any() else 2.0 for i in range(12)]  # no cosine is 2
        return pd.DataFrame({"lang": g["lang"].iloc[0], "k": range(len(own)), "centroid": [c.tobytes() for c in own], "least": [least] * len(own)})

    got = seen.groupBy("lang").applyInPandas(cluster, "lang string, k int, centroid binary, least array<double>").toPandas().sort_values(["lang", "k"], ignore_index=True)
    if got.empty:
        return Model([], np.zeros((0, dims), np.float32), np.ones(dims), np.zeros(12))
    least = np.stack(got["least"].tolist()).min(0)
    top = int(np.flatnonzero(least < 2).max())
    floor = np.array([s.reject_share * least[min(i, top) :].min() for i in range(12)])
    return Model(got["lang"].tolist(), np.stack([np.frombuffer(c, np.float32) for c in got["centroid"]]), idf, floor)


def predict(docs: DataFrame, model: Model, text: str, keep: list[str]) -> DataFrame:
    """docs' columns `keep` and lang_pred, score (cosine, 0 to 1), rejected.

    A null text, or one without letters, is `und` with score 0 and rejected. So is every text if nothing was learned.
    Equal cosines go to the language first in alphabetical order. Columns of these names in `keep` are not allowed (ValueError).
    """
    apart(keep, ["lang_pred", "score", "rejected"])
    dims = len(model.idf)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 128):
                part = b.iloc[i : i + 128]
                got = [counts(t, dims) for t in part["__text"]]
                letters = np.array([n for _, n in got])
                out = part.drop(columns="__text")
                if len(model.languages):
                    cos = _vectors(np.stack([c for c, _ in got]), model.idf) @ model.centroids.T
                    best, score = cos.argmax(1), np.clip(cos.max(1), 0, 1).astype(float)
                    name = np.array(model.languages, object)[best]
                    far = score < model.floor[_length_class(letters)]
                else:
                    name, score, far = np.full(len(part), UNKNOWN, object), np.zeros(len(part)), np.ones(len(part), bool)
                name[letters == 0] = UNKNOWN
                score[letters == 0] = 0.0
                yield out.assign(lang_pred=name, score=score, rejected=far | (letters == 0))

    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInPandas(label, f"{schema}, lang_pred string, score double, rejected boolean")
