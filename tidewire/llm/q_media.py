"""Query op6: every document's text stored as a progressive JPEG, read back and summed up."""

from __future__ import annotations

import hashlib
import zlib

from tidewire.llm.media import read_media, to_media

SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(media, payload, rgb):
    sums = rgb.reshape(-1, 3).sum(0, dtype="int64")
    feature = f"{rgb.shape[0]}x{rgb.shape[1]}x3;sum={','.join(map(str, sums))};crc32={zlib.crc32(rgb.tobytes()):08x}"
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return len(payload), sha(payload), zlib.crc32(payload[-32:]), len(media), sha(media), feature


def op6_media(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_media(to_media(docs, "text", ["doc_id"]), ["doc_id", "n_bytes"], SCHEMA, digest)


QUERIES = {"op6_media": op6_media}
