"""Query op7: all documents packed into sequences of at most 1024 tokens."""

from __future__ import annotations

import base64
import json
import re

from tidewire.llm.packing import pieces, place

CAPACITY, END = 1024, 2
LIBRARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
BLANK = 10_000  # a longer run of white space goes to the library itself


def byte_bpe_encoder():
    """ids as tokenizers gives them for byte_bpe_50k.json with add_special_tokens=False.

    Texts without the file's added tokens and without very long runs of white space, on which the fast encoder of the same
    vocabulary and split pattern would overflow its stack, are encoded by that; all others by the library itself. tests/llm
    holds one against the other.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(LIBRARY), encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    blank = re.compile(rf"\s{{{BLANK}}}")
    library = []

    def encode(text: str) -> list[int]:
        if not any(a in text for a in added) and (len(text) < BLANK or not blank.search(text)):
            return fast(text)
        if not library:
            from tokenizers import Tokenizer

            library.append(Tokenizer.from_file(public_tokenizers.path(LIBRARY)))
        return library[0].encode(text, add_special_tokens=False).ids

    return encode


def op7_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut_up = pieces(docs, "text", ["doc_id"], byte_bpe_encoder, END, CAPACITY)
    return place(cut_up, CAPACITY, "length", ["doc_id", "piece", "start", "ids_crc32"])


QUERIES = {"op7_packing": op7_packing}
