"""Query op4: the 20 nearest vectors of every vector whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.llm.neighbours import nearest


def op4_neighbours(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, "vec_id", "embedding")


QUERIES = {"op4_neighbours": op4_neighbours}
