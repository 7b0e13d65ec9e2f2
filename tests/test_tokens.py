import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as T


@pytest.mark.parametrize("text, want", [(" \t\n\x0b\f\rA b\r\n", ["a", "b"]), ("a \u0085", ["a", "\u0085"]), ("a \u2028", ["a", "\u2028"]), ("\u00a0a", ["\u00a0a"]), (" \n", []), (None, [])])
def test_tokens_and_their_runs(spark, text, want):
    """White space goes at the true ends only, not before a last mark that ends a line; runs are numbered by place."""
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.tokens(F.col("t"))).head()[0] == want
    assert len(df.select(T.shingle_numbers(T.tokens(F.col("t")))).head()[0]) == (1 if want else 0)


def test_runs_differ_as_their_texts_do(spark):
    df = spark.createDataFrame([("a b c d e f a b c d e",)], "t string")
    n, s = df.select(T.shingle_numbers(T.tokens(F.col("t"))), T.shingles(T.tokens(F.col("t")))).head()
    assert len(n) == 7 and len(set(n)) == len(s) == 6 and n[0] == n[6]
