"""Query op3: every document encoded into pieces and decoded again."""

from __future__ import annotations

import hashlib
import zlib

from tidewire.llm.sentencepieces import encode

MODEL = "piece_bpe_32k.model"


def digest(pieces, text, ids):
    back = pieces.decode(ids.tolist())
    return len(ids), zlib.crc32(ids.tobytes()), back == text, hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()


def op3_sentencepieces(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema = "n_ids long, ids_crc32 long, round_trip boolean, decoded_sha256 string"
    return encode(docs, public_tokenizers.path(MODEL), "text", ["doc_id"], schema, digest)


QUERIES = {"op3_sentencepieces": op3_sentencepieces}
