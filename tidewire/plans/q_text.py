"""Queries of text, URL, page and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import numbers as N
from tidewire.functions import text as T
from tidewire.functions import urls as U
from tidewire.plans.base import events, query
from tidewire.session import bounded_batches, table

_TRACK = ", ".join(f"'{t}'" for t in U.TRACKING)
_TOKENS = "CASE WHEN regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') = '' THEN [] ELSE regexp_split_to_array(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+') END"


@query(
    "content_hashes",
    "SELECT doc_id, sha256(text) AS raw_hash, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS content_hash FROM documents",
)
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.text_hash(F.col("text")).alias("raw_hash"), T.row_hash(F.col("text")).alias("content_hash"))


@query(
    "normalize_text",
    """SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]', '', 'g'),
      '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS normal_hash FROM documents""",
)
def normalize_text(spark, sf_dir):
    """The whole normal form; the SQL has the steps that these texts need."""
    bounded_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("normal_hash"))


@query(
    "clustering_text",
    """WITH t AS (SELECT doc_id, substr(regexp_replace(split_part(text, chr(10), 1), '^\\s+|\\s+$', '', 'g'), 1, 500) AS title, substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 2000) AS body FROM documents)
    SELECT doc_id, sha256(CASE WHEN title <> '' AND body <> '' THEN title || chr(10) || chr(10) || body ELSE title || body END) AS input_hash FROM t""",
)
def clustering_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(T.clustering_text(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("text")), 256).alias("input_hash"))


@query(
    "shingle_counts",
    f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents)
    SELECT doc_id, CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS INTEGER) AS shingles FROM t""",
)
def shingle_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.shingles(T.tokens(F.col("text")))).alias("shingles"))


@query(
    "extract_metadata",
    """SELECT doc_id, CAST(len(regexp_extract_all(chr(10) || text, '(?i)https?://[^\\s<>\"]+|www\\.[^\\s<>\"]+')) AS INTEGER) AS urls,
      array_to_string(regexp_extract_all(chr(10) || text, '\\d+(?:[.,/]\\d+)*')[1:40], ' ') AS numbers, CAST(length(text) + 1 AS INTEGER) AS content_length FROM documents""",
)
def extract_metadata(spark, sf_dir):
    m = table(spark, sf_dir, "documents").select("doc_id", T.metadata(F.lit(""), F.col("text")).alias("m"))
    return m.select("doc_id", F.size("m.urls").alias("urls"), F.array_join("m.numbers", " ").alias("numbers"), F.col("m.content_length").alias("content_length"))


@query(
    "canonical_urls",
    f"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host,
      regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
    s AS (SELECT *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT list_contains([{_TRACK}], lower(split_part(x, '=', 1))))), '&') AS kept FROM p)
    SELECT page_id, scheme || '://' || regexp_replace(host, CASE WHEN scheme = 'http' THEN ':80$' ELSE ':443$' END, '') ||
      CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical FROM s""",
)
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(
    "effective_urls",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^([A-Za-z]+://[^/?#]*).*$', '\\1') || '/own' WHEN 1 THEN url WHEN 2 THEN url
      ELSE regexp_extract(url, '^([A-Za-z]+://)', 1) || 'x.' || regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) || '/sub' END AS effective FROM pages""",
)
def effective_urls(spark, sf_dir):
    """Relative, missing, foreign and sub-domain canonical links."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id") % 4
    link = F.when(k == 0, "/own").when(k == 2, "https://elsewhere.test/a").when(k == 3, F.concat(F.regexp_extract("url", r"^([A-Za-z]+://)", 1), F.lit("x."), F.regexp_extract("url", r"^[A-Za-z]+://([^/?#]*)", 1), F.lit("/sub")))
    return p.select("page_id", U.effective_url(F.col("url"), link).alias("effective"))


@query(
    "redact_urls",
    """SELECT page_id, regexp_replace(url, '[?#].*$', '') || '?page=' || page_id || '&api_token=%5BREDACTED%5D&x=1' AS redacted FROM pages""",
)
def redact_urls(spark, sf_dir):
    address = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("?page="), F.col("page_id").cast("string"), F.lit("&api_token=abc"), F.col("page_id").cast("string"), F.lit("&x=1"))
    return table(spark, sf_dir, "pages").select("page_id", U.redact_url(address).alias("redacted"))


@query(
    "html_titles",
    """SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?i)<p[ >]')) AS INTEGER) AS paragraphs,
      regexp_extract(html, '(?i)<html[^>]*\\slang="([^"]*)"', 1) AS language FROM pages""",
)
def html_titles(spark, sf_dir):
    from tidewire.sources.pages import language, paragraph_count, raw_title

    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", raw_title(h).alias("title"), paragraph_count(h).alias("paragraphs"), language(h).alias("language"))


@query("html_article_text")
def html_article_text(spark, sf_dir):
    from tidewire.sources.pages import articles

    return articles(table(spark, sf_dir, "pages"), "page_id", "url", "html")


@query(
    "content_words",
    "SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS INTEGER) AS words FROM documents",
)
def content_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.content_words(F.col("text"))).alias("words"))


@query(
    "lead_sentences",
    """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 15)[1:5], ' | ') AS lead FROM documents""",
)
def lead_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.sentences(F.col("text")), " | ").alias("lead"))


@query(
    "fact_hashes",
    """SELECT item_id, substr(sha256(lower(regexp_replace(regexp_replace(regexp_replace(text, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))), 1, 16) AS fact FROM benchmark""",
)
def fact_hashes(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.fact_hash(F.col("text")).alias("fact"))


@query("json_props", """SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type""")
def json_props(spark, sf_dir):
    k = N.counter(F.get_json_object("props", "$.k"))
    return events(spark, sf_dir).groupBy("event_type").agg(F.sum(k).alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    "sanitized_counters",
    """SELECT event_id, CASE WHEN TRY_CAST(v AS BIGINT) >= 0 THEN TRY_CAST(v AS BIGINT) END AS counter FROM (SELECT event_id,
      CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '-5' WHEN 2 THEN 'many' END AS v FROM events)""",
)
def sanitized_counters(spark, sf_dir):
    k = F.col("event_id") % 4
    v = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, "-5").when(k == 2, "many")
    return events(spark, sf_dir).select("event_id", N.counter(v).alias("counter"))


@query(
    "ip_ranges",
    """WITH r(name, lo, hi) AS (VALUES ('this', 0, 16777215), ('private10', 167772160, 184549375), ('carrier', 1681915904, 1686110207), ('loopback', 2130706432, 2147483647), ('linklocal', 2851995648, 2852061183),
      ('private172', 2886729728, 2887778303), ('protocol', 3221225472, 3221225727), ('test1', 3221225984, 3221226239), ('relay', 3227017984, 3227018239), ('private192', 3232235520, 3232301055),
      ('benchmark', 3323068416, 3323199487), ('test2', 3325256704, 3325256959), ('test3', 3405803776, 3405804031), ('multicast', 3758096384, 4026531839), ('reserved', 4026531840, 4294967295)),
    a AS (SELECT c_custkey, (CAST(c_custkey AS BIGINT) * 28633115 + 77) % 4294967296 AS ip FROM customer UNION ALL SELECT -n_nationkey - 1, lo + n_nationkey FROM nation, r)
    SELECT c_custkey, ip, name AS refused FROM a LEFT JOIN r ON ip BETWEEN lo AND hi""",
)
def ip_ranges(spark, sf_dir):
    """Addresses that must not be fetched, and some at the start of every block."""
    from ipaddress import ip_network

    from tidewire.sources.addresses import BLOCKS, refused

    a = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey").cast("long") * 28633115 + 77) % 4294967296).alias("ip"))
    starts = F.array(*[F.lit(int(ip_network(block).network_address)) for block in BLOCKS.values()])
    n = table(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("c_custkey"), F.explode(starts).alias("lo"), "n_nationkey")
    a = a.unionByName(n.select("c_custkey", (F.col("lo") + F.col("n_nationkey")).alias("ip")))
    return refused(a, "ip").select("c_custkey", "ip", "refused")
