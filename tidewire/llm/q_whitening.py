"""Query op12: embeddings whitened along their first 8 components."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.llm.whitening import whitening


def op12_whitening(spark, sf_dir):
    got = whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return got.withColumn("deviation", F.col("deviation").cast("long"))  # of 10^9 vectors and more it may not fit, which fails


QUERIES = {"op12_whitening": op12_whitening}
