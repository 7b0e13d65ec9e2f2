"""Query op1: documents linked by a Jaccard similarity of at least 0.85 over their 4-word shingles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.llm.jaccard import classes


def op1_jaccard(spark, sf_dir):
    got = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", n=4, percent=85)
    return got.select("doc_id", F.col("n_tokens").alias("n_shingles"), F.col("component").alias("component_id"), "class_id")


ORACLES = {
    "op1_jaccard": r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
    f AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, count(*) AS i FROM f x JOIN f y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
    r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
    c AS (SELECT a, min(b) AS b FROM r GROUP BY a), k AS (SELECT a, min(b) AS b FROM p WHERE i = n AND i = m GROUP BY a)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c.b, doc_id)) AS component_id, least(doc_id, coalesce(k.b, doc_id)) AS class_id
    FROM s LEFT JOIN c ON c.a = doc_id LEFT JOIN k ON k.a = doc_id
    """
}
QUERIES = {"op1_jaccard": op1_jaccard}
