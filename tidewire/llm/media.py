"""Media columns: payloads stored losslessly as the coefficients of progressive JPEG files, and read back as tensors.

A byte is one quantised coefficient (quantisation 1): b below 128 as b + 2, others as b - 257, so that none is 0 or has
magnitude 1 and successive approximation needs no run of zeros. The blocks go to the Y, Cb and Cr planes of a 4:2:0
image in that order; the file's comment holds the payload's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import progressive_jpeg as jpeg
from tidewire.llm.common import apart

UNIT = 576
_TO = np.where(np.arange(256) < 128, np.arange(256) + 2, np.arange(256) - 257).astype(np.int32)


def pad(raw: bytes) -> bytes:
    """raw with bytes 255 up to a positive multiple of 576."""
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def store(payload: bytes) -> bytes:
    """The payload as one progressive JPEG file."""
    units = -(-len(payload) // 384) or 1
    cols = max(min(units, 16), -(-units // 4095))
    rows = -(-units // cols)
    if cols > 4095:
        raise ValueError("payload too large for one image")
    coef = np.full(rows * cols * 384, 2, np.int32)
    coef[: len(payload)] = _TO[np.frombuffer(payload, np.uint8)]
    n = rows * cols * 64
    y, cb, cr = coef[: 4 * n].reshape(2 * rows, 2 * cols, 64), coef[4 * n : 5 * n], coef[5 * n :]
    return jpeg.encode(y, cb.reshape(rows, cols, 64), cr.reshape(rows, cols, 64), b"payload %d" % len(payload))


def load(media: bytes) -> tuple[bytes, np.ndarray]:
    """The payload and the RGB tensor of a stored file."""
    parts, head = jpeg.decode(media)
    flat = np.concatenate([p.ravel() for p in parts])
    n = int(head["comments"][0].split()[1])
    return np.where(flat[:n] > 0, flat[:n] - 2, flat[:n] + 257).astype(np.uint8).tobytes(), jpeg.to_rgb(parts, head)


def _schema(df: DataFrame, names: list[str], more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema] + [more])


def to_media(df: DataFrame, text: str, keep: list[str], slice_rows: int = 64) -> DataFrame:
    """keep, n_bytes and media: the UTF-8 bytes of each whole text, padded and stored. A null text counts as empty.
    A kept column named like an output is an error."""
    apart(keep, ["n_bytes", "media"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), slice_rows):
                part = b.iloc[i : i + slice_rows]
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part["__text"]]
                yield part.drop(columns="__text").assign(n_bytes=[len(x) for x in raw], media=[store(pad(x)) for x in raw])

    rows = df.select(*keep, F.col(text).alias("__text"))
    return rows.mapInPandas(run, _schema(df, keep, "n_bytes long, media binary"))


def read_media(df: DataFrame, keep: list[str], schema: str | None = None, reduce: Callable[[bytes, bytes, np.ndarray], tuple] | None = None, slice_rows: int = 64) -> DataFrame:
    """keep and, of each row's media: payload binary, height, width int, rgb binary (height x width x 3).

    With `reduce` and its `schema`, each file's (media, payload, tensor) is reduced in the worker instead, and no tensor
    is shipped. A kept column named like an output is an error.
    """
    schema = schema or "payload binary, height int, width int, rgb binary"
    names = [x.split()[0] for x in schema.split(",")]
    apart(keep, names)
    of = reduce or (lambda media, payload, rgb: (payload, rgb.shape[0], rgb.shape[1], rgb.tobytes()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), slice_rows):
                part = b.iloc[i : i + slice_rows]
                got = [of(bytes(m), *load(bytes(m))) for m in part["__media"]]
                out = part.drop(columns="__media")
                for k, name in enumerate(names):
                    out[name] = [x[k] for x in got]
                yield out

    rows = df.select(*keep, F.col("media").alias("__media"))
    return rows.mapInPandas(run, _schema(df, keep, schema))
