"""Query op5: the main text of every page."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.llm.html_extraction import main_text


def op5_html(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = main_text(pages, "url", "html", ["page_id", "url"])
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path", "consensus")


QUERIES = {"op5_html": op5_html}
