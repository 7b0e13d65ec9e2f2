"""The corpus pipeline: language ID, n-gram Jaccard join, substring dedup, best-fit packing.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns the columns of documents; the
last returns the packed pieces. Defined results for odd rows are those of the operators: a null text is rejected by the
first stage like any text without letters; rows that share a doc_id are kept or dropped together by the second.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import cut, small
from tidewire.llm.jaccard import classes
from tidewire.llm.langid import fit, predict
from tidewire.llm.packing import pieces, place
from tidewire.llm.q_langid import held_out
from tidewire.llm.q_packing import CAPACITY, END, byte_bpe_encoder
from tidewire.llm.substrings import dedup
from tidewire.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts are of any length, so a batch on its way to a Python worker is bounded by bytes first; both sides hold two of them.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
REPEAT = 50  # words; a shorter passage that repeats stays


def bounded(stage):
    """The stage, with BATCH set in the session. Settings stay, since a stage's rows are computed when they are written."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in BATCH.items():
            spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told with confidence. The classifier learns from the table's labelled rows."""
    model = fit(spark.read.parquet(f"{sf_dir}/documents.parquet").where(~held_out()), "text", "lang", F.col("doc_id"))
    return predict(docs.select(*COLUMNS, F.col("text").alias("__read")), model, "__read", COLUMNS).where(~F.col("rejected")).select(*COLUMNS)


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id. Five words, similarity 0.8."""
    groups = classes(docs, "doc_id", "text")
    other = small(cut(groups.where(F.col("component") < F.col("doc_id")).select(F.col("doc_id").alias("__gone")).distinct()), 500_000)
    return docs.join(other, F.col("doc_id") == F.col("__gone"), "left_anti").select(*COLUMNS)


@bounded
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of at least 50 words that an earlier document has. Texts without such a passage stay as they
    are; of others, the words left are joined by one space, and a document of which nothing is left goes."""
    got = dedup(docs, "doc_id", "text", COLUMNS, k=REPEAT)
    left = got.withColumn("text", F.when(F.col("removed") > 0, F.col("kept")).otherwise(F.col("text")))
    left = left.where((F.col("removed") == 0) | (F.col("kept") != ""))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@bounded
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts, each with its place in one of as few sequences of at most 1024 tokens as can be.

    A null text counts as empty and is one piece, the end token. Rows that repeat, or share a doc_id, have pieces of their
    own; pieces of one size that agree in doc_id, place and ids are interchangeable. An empty table gives an empty one.
    """
    return place(pieces(docs, "text", ["doc_id"], byte_bpe_encoder, END, CAPACITY), CAPACITY, "length", ["doc_id", "piece", "start", "ids_crc32"])


STAGES = [("language_id", language), ("jaccard_join", near_duplicates), ("substring_dedup", repeats), ("best_fit_packing", packed)]
#: Trained classifiers and tokenizers are not SQL; tests/llm holds each stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
