"""Query op11: the phrases of two and three words that stand out in each language of documents."""

from __future__ import annotations

from tidewire.llm.collocations import collocations


def op11_collocations(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", "text")


ORACLES = {
    "op11_collocations": r"""
    WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
    pieces AS (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS x FROM t),
    w AS (SELECT lang, list_filter(regexp_split_to_array(x, '[\x20\x09]+'), lambda y: y <> '') AS w FROM pieces),
    g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, w[i:i + m - 1] AS w FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3]) AS m FROM w))),
    f AS MATERIALIZED (SELECT lang, m, phrase, any_value(w) AS w, count(*) AS f FROM g GROUP BY lang, m, phrase),
    total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
    parts AS (SELECT lang, m, phrase, w, f AS a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1 AND f >= 10)),
    cuts AS (SELECT c.lang, c.m, c.phrase, c.w, a, k, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
        FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.x JOIN f y ON y.lang = c.lang AND y.phrase = c.y),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, m, phrase ORDER BY score, k) = 1),
    longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM f WHERE m = 3 AND f >= 10) GROUP BY lang, phrase),
    kept AS (SELECT best.* FROM best LEFT JOIN longer o ON o.lang = best.lang AND o.phrase = best.phrase AND best.m = 2 WHERE o.f IS NULL OR 100 * o.f < 50 * best.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
    """
}
QUERIES = {"op11_collocations": op11_collocations}
