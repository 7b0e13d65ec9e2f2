"""Query op13: the quality of every document, learned from labels of those of which crc32(doc_id) mod 4 is not 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.llm.quality import assess, fit


def _remainder():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4


def op13_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_remainder() != 2)
    model = fit(docs, "doc_id", "text", labels, "doc_id", "quality")
    got = assess(docs.withColumn("held_out", _remainder() == 2), model, "text", ["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "quality")


QUERIES = {"op13_quality": op13_quality}
