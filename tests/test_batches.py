"""Whole texts on their way to Python."""

import html
import unicodedata

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.plans.catalogue import QUERIES


def test_texts_go_to_python_in_bounded_batches_and_only_if_they_must(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        QUERIES["normalize_text"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    texts = ["plain & simple", "<b>a &amp; b</b>", "<p>x</p>y", "ﬁne ① é", "<i>&eacute; ﬁ</i>", "", "&amp; no tag", "<b></b>"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(T.normalize(F.col("t"))).collect()]
    want = ["plain & simple", "a & b", "x\ny", "fine 1 é", "é fi", "", "&amp; no tag", ""]
    assert got == want and unicodedata.normalize("NFKC", html.unescape("&eacute; ﬁ")) == "é fi"
