"""Words and word n-grams as 64-bit numbers, in numpy.

A word is a run of bytes other than space and 9 to 13; its number is its XXH3 hash. An n-gram's number is a polynomial of
its words' numbers modulo 2^64, mixed.
"""

from __future__ import annotations

import numpy as np
import xxhash

_M = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xBF58476D1CE4E5B9)
_D = np.uint64(0x94D049BB133111EB)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 60_000:
            self.clear()
        self[word] = n = xxhash.xxh3_64_intdigest(word)
        return n


_numbers = _Numbers()


def split(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()  # of bytes: ASCII letters and ASCII white space only


def numbers(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_numbers.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _C
    x = (x ^ (x >> np.uint64(27))) * _D
    return x ^ (x >> np.uint64(31))


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """The numbers of all n-grams, by place; none if there are fewer words."""
    if len(w) < n:
        return w[:0]
    out = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        out *= _M
        out += w[k : len(w) - n + 1 + k]
    return mix(out)


def shingles(w: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct n-grams; of fewer words, the whole sequence as one; of none, none."""
    if 0 < len(w) < n:
        return mix(grams(w, len(w)), len(w))
    return np.unique(grams(w, n))


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs; the first byte says how many."""
    top = int(x.max()) if len(x) else 0
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)
