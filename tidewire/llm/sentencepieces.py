"""SentencePiece encoding and decoding by one Viterbi pass over an Aho-Corasick automaton of the pieces.

The automaton reads a text once; at each position its output links give every piece that ends there, and each relaxes the
best score of that position. Characters that no piece covers cost `unknown_penalty` below the least score and become byte
pieces. Of equal scores the longer last piece wins.

No piece has the space mark after another character, so the best path always breaks before such a mark; texts are cut
there and each distinct unit is solved once and remembered. Where a model has other pieces, whole texts are solved.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_REMEMBERED = 400_000


class Pieces:
    """A model's pieces with their scores. Spaces are marks; a text starts with one more, which decoding takes off."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int], unknown: int, unknown_penalty: float = 10.0):
        """pieces: (text, id, score); byte_ids: of bytes 0 to 255, or empty, and then uncovered characters are `unknown`."""
        self.byte_ids, self.unknown = byte_ids, unknown
        self.worst = min((s for _, _, s in pieces), default=0.0) - unknown_penalty
        self.automaton = ahocorasick.Automaton()
        for text, i, score in pieces:
            self.automaton.add_word(text, (len(text), i, score))
        self.automaton.make_automaton()
        inner = any(MARK in t.lstrip(MARK) for t, _, _ in pieces)
        self.unit = re.compile(r"(?s).+" if inner else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, bytes] = {}
        top = max([i for _, i, _ in pieces] + byte_ids + [unknown]) + 1
        self.spell = [b""] * top
        self.spell[unknown] = " ⁇ ".encode()
        for text, i, _ in pieces:
            self.spell[i] = text.replace(MARK, " ").encode()
        for v, i in enumerate(byte_ids):
            self.spell[i] = bytes([v])

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        return cls(plain, [i for i in ids if sp.is_byte(i)], sp.unk_id())

    def best(self, unit: str) -> list[int]:
        """The ids of the best-scoring path over one unit."""
        n = len(unit)
        score, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        at = 0  # positions up to here are final: uncovered characters have been relaxed
        single = -1

        def close(upto):
            nonlocal at
            while at < upto:  # every character may also stand alone, at the worst score, if it is no piece itself
                at += 1
                if single != at and score[at - 1] + self.worst > score[at]:
                    score[at], back[at] = score[at - 1] + self.worst, (at - 1, -1)

        for end, (size, i, s) in self.automaton.iter(unit):
            end += 1
            close(end - 1)
            if size == 1:
                single = end
            if score[end - size] + s > score[end]:
                score[end], back[end] = score[end - size] + s, (end - size, i)
        close(n)
        out = []
        while n:
            start, i = back[n]
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(unit[start:n].encode("utf-8", "surrogatepass"))]
            else:
                out.append(self.unknown)
            n = start
        return out[::-1]

    def _solve(self, unit: str) -> bytes:
        got = np.array(self.best(unit), "<u4").tobytes()
        if len(unit) <= 64:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            self.known[unit] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        get = self.known.get
        marked = MARK + text.replace(" ", MARK)
        return np.frombuffer(b"".join([get(u) or self._solve(u) for u in self.unit.findall(marked)]), "<u4")

    def decode(self, ids) -> str:
        raw = b"".join(map(self.spell.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str, keep: list[str], schema: str = "ids array<int>", reduce: Callable[[Pieces, str, np.ndarray], tuple] | None = None) -> DataFrame:
    """keep and the ids of each whole text. A null or empty text has none.

    With `reduce` and its `schema`, each (pieces, text, ids) is reduced in the worker instead of being shipped.
    """
    names = [x.rsplit(" ", 1)[0].strip() for x in re.split(r",(?![^<]*>)", schema)]
    of = reduce or (lambda pieces, t, ids: (ids.astype(np.int32),))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces.load(path)
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                got = [of(pieces, t or "", pieces.encode(t or "")) for t in part["__text"]]
                out = part.drop(columns="__text")
                for k, name in enumerate(names):
                    out[name] = [x[k] for x in got]
                yield out

    rows = docs.select(*keep, F.col(text).alias("__text"))
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return rows.mapInPandas(run, ", ".join([*own, schema]))


def decode(rows: DataFrame, path: str, keep: list[str], ids: str = "ids", to: str = "text") -> DataFrame:
    """keep and the text that the ids spell. Bytes that are no UTF-8 become replacement characters; null ids, empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces.load(path)
        for b in batches:
            yield b.drop(columns="__ids").assign(**{to: [pieces.decode([] if x is None else x) for x in b["__ids"]]})

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
    return rows.select(*keep, F.col(ids).alias("__ids")).mapInPandas(run, ", ".join([*own, f"{to} string"]))
