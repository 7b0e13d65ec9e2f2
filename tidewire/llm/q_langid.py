"""Query op8: the language of every document, learned from those of which crc32(doc_id) mod 3 is not 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.llm.langid import fit, predict


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def op8_langid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()), "text", "lang", F.col("doc_id"))
    got = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, "text", ["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES = {"op8_langid": op8_langid}
