"""Evidence of stories, tasks still to be asked, and checked answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import answers as A
from tidewire.plans.base import as_of, query
from tidewire.session import table

# Labels of a judgement.
LABELS = ("SAME_EVENT", "MATERIAL_UPDATE", "RELATED_BUT_DISTINCT", "UNRELATED")
JUDGEMENT = [A.Field("label", "label", labels=LABELS), A.Field("confidence", "share"), A.Field("reason_codes", "texts", needed=False, default=[], most=8, longest=64)]
_CLIP = r"CASE WHEN length({0}) > {1} THEN {0}[:{1}] || '…' ELSE {0} END"
_TRIM = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"


@query(
    "answers_checked",
    """WITH a AS (SELECT conv_id, turn, (conv_id + turn) % 7 AS shape, role FROM conversations)
    SELECT conv_id, turn, CASE shape WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'repaired' WHEN 3 THEN 'invalid_json' WHEN 4 THEN 'invalid_shape' ELSE 'invalid_fields' END AS status,
    CASE shape WHEN 5 THEN 'label: label,confidence: range' WHEN 6 THEN 'confidence: missing,reason_codes: type' ELSE '' END AS faults,
    CASE WHEN shape < 3 THEN CASE WHEN role = 'user' THEN 'SAME_EVENT' ELSE 'UNRELATED' END END AS label, CASE WHEN shape < 3 THEN round((turn % 10) / 10, 4) END AS confidence, CASE WHEN shape < 3 THEN CASE shape WHEN 1 THEN 0 ELSE 2 END END AS reasons FROM a""",
)
def answers_checked(spark, sf_dir):
    """Turns as answers in seven shapes: plain, fenced, within prose, cut off, of another shape, and with wrong fields."""
    c = table(spark, sf_dir, "conversations")
    shape = (F.col("conv_id") + F.col("turn")) % 7
    label, sure = F.when(F.col("role") == "user", "SAME_EVENT").otherwise("UNRELATED"), F.round((F.col("turn") % 10) / 10, 4)
    two = F.array(F.lit("a"), F.coalesce("text", F.lit("")))
    whole = F.to_json(F.struct(label.alias("label"), sure.alias("confidence"), two.alias("reason_codes")))
    text = (
        F.when(shape == 0, whole)
        .when(shape == 1, F.concat(F.lit("```json\n"), F.to_json(F.struct(label.alias("label"), sure.cast("string").alias("confidence"))), F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Here it is: "), whole, F.lit(" - as asked.")))
        .when(shape == 3, F.concat(F.lit('{"label": '), F.to_json(two)))
        .when(shape == 4, F.to_json(two))
        .when(shape == 5, F.to_json(F.struct(F.lit("OTHER").alias("label"), F.lit(1.5).alias("confidence"))))
        .otherwise(F.to_json(F.struct(label.alias("label"), F.lit("none").alias("reason_codes"))))
    )
    # A text with both braces would be mended where shapes 3 and 4 are not to be.
    text = F.when(shape.isin(3, 4), F.translate(text, "}", ")")).otherwise(text)
    got = A.checked(c.select("conv_id", "turn", text.alias("answer")), "answer", JUDGEMENT)
    return got.select("conv_id", "turn", "status", F.array_join("faults", ",").alias("faults"), "value.label", "value.confidence", F.when(F.col("value").isNotNull(), F.size("value.reason_codes")).alias("reasons"))


@query(
    "tasks_pending",
    """SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents l WHERE l.text IS NOT DISTINCT FROM d.text AND l.lang IS NOT DISTINCT FROM d.lang AND l.doc_id % 3 = 0 AND (l.doc_id % 2 = 1 OR l.doc_id % 5 <> 0))""",
)
def tasks_pending(spark, sf_dir):
    """Documents without a good answer for their text and language; every third has one, some of them past their end."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("text"), 256).alias("hash"))
    k = F.col("doc_id")
    ends = F.when(k % 2 == 0, F.when(k % 5 != 0, as_of() + F.expr("INTERVAL 1 DAY")).otherwise(as_of()))
    return A.pending(d, d.where(k % 3 == 0).withColumn("ends", ends), ["hash", "lang"], as_of(), "ends").select("doc_id", "lang")


@query(
    "story_evidence",
    f"""WITH t AS (SELECT doc_id, source, lang, {_TRIM} AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id % 10 = 0 DESC, doc_id) AS n FROM documents),
    s AS (SELECT *, 'https://' || coalesce(lang, 'x') || '.example/' || doc_id % 3 AS url FROM t WHERE n <= 6), u AS (SELECT source, url, min(n) AS n FROM s GROUP BY ALL)
    SELECT source AS story, string_agg({_CLIP.format("t", 220)}, '|' ORDER BY n) AS titles, string_agg({_CLIP.format("t", 900)}, '|' ORDER BY n) AS texts, CAST(count(*) AS INTEGER) AS items,
    (SELECT string_agg(url, ' ' ORDER BY u.n) FROM u WHERE u.source IS NOT DISTINCT FROM s.source) AS urls FROM s GROUP BY source""",
)
def story_evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    address = F.concat(F.lit("https://"), F.coalesce("lang", F.lit("x")), F.lit(".example/"), (F.col("doc_id") % 3).cast("string"))
    m = d.select("doc_id", F.col("source").alias("story"), "source", F.col("text").alias("title"), "text", address.alias("url"), (F.col("doc_id") % 10 == 0).alias("primary"))
    got = A.evidence(m, "story", "primary", "doc_id", "doc_id")
    told = lambda n: F.array_join(F.transform("items", lambda x: x[n]), "|")
    return got.select("story", told("title").alias("titles"), told("text").alias("texts"), F.size("items").alias("items"), F.array_join("urls", " ").alias("urls"))
