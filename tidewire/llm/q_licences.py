"""Query op10: the licences that every document names, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.llm.licences import BREAK, CUES, OTHER, WRAP, known, ordered_rules, scan


def op10_licences(spark, sf_dir):
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", ["doc_id"])
    return found.select(
        "doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), "unmatched"
    )


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(s)}, {q(i)})" for s, i in known().items())
    steps, last = [], "seqs"
    for k, (name, pattern) in enumerate(ordered_rules()):
        steps.append(f"""r{k} AS (SELECT doc_id, sentence_ids, replace(rest, {q(pattern)}, '|') AS rest,
          CASE WHEN contains(rest, {q(pattern)}) THEN list_append(found, {q(name)}) ELSE found END AS found, rn FROM {last})""")
        last = f"r{k}"
    return f"""
    WITH known(s, i) AS (VALUES {values}),
    rows AS (SELECT doc_id, text, row_number() OVER () AS rn FROM documents),
    cued AS (SELECT rn, regexp_replace(text, {q(BREAK)}, '\\1' || chr(10) || chr(10), 'g') AS t FROM rows
      WHERE regexp_matches(lower(text), {q("|".join(CUES))})),
    both_cuts AS (SELECT rn, 1 AS way, t FROM cued UNION ALL SELECT rn, 2, regexp_replace(t, {q(WRAP)}, '\\1 \\2', 'g') FROM cued),
    parts AS (SELECT rn, way, string_split(lower(regexp_replace(t, {q(OTHER)}, ' ', 'g')), chr(10)) AS p FROM both_cuts),
    flat AS (SELECT rn, way, unnest(p) AS s, generate_subscripts(p, 1) AS pos FROM parts),
    each AS (SELECT rn, way, list(i ORDER BY pos) AS ids FROM flat JOIN known ON trim(flat.s) = known.s GROUP BY rn, way),
    hits AS (SELECT rn, ids FROM each QUALIFY row_number() OVER (PARTITION BY rn ORDER BY len(ids) DESC, way) = 1),
    seqs AS (SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
      coalesce('<' || array_to_string(ids, '><') || '>', '') AS rest, CAST([] AS VARCHAR[]) AS found, rows.rn
      FROM rows LEFT JOIN hits USING (rn)),
    {", ".join(steps)}
    SELECT doc_id, sentence_ids, coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS licences,
      CAST(length(rest) - length(replace(rest, '<', '')) AS INTEGER) AS unmatched FROM {last}
    """


QUERIES = {"op10_licences": op10_licences}
ORACLES = {"op10_licences": _sql()}
