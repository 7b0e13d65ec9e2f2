"""Query op2: every document without the words of 13-word windows that start in an earlier document."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.llm.substrings import dedup


def op2_substrings(spark, sf_dir):
    got = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", ["doc_id"], k=13)
    return got.select("doc_id", F.col("words").alias("n_words"), F.col("removed").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLES = {
    "op2_substrings": r"""
    WITH w AS (SELECT doc_id, row_number() OVER () AS rn, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    e AS (SELECT doc_id, rn, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, rn, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
    m AS (SELECT g, min(doc_id) AS least FROM e GROUP BY g),
    c AS (SELECT DISTINCT rn, i + j AS p FROM e JOIN m USING (g), range(13) t(j) WHERE least < doc_id),
    f AS (SELECT rn, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
    k AS (SELECT rn, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM f ANTI JOIN c USING (rn, p) GROUP BY rn)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (rn)
    """
}
QUERIES = {"op2_substrings": op2_substrings}
