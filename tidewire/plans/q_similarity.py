"""Similarity, vectors, matching and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewire.functions import fuzzy
from tidewire.functions import numbers as N
from tidewire.functions import text as T
from tidewire.operators import lsh
from tidewire.operators import matching as M
from tidewire.operators import similarity as S
from tidewire.operators.vectors import Collection, Identity
from tidewire.plans.base import as_of, query
from tidewire.session import checkpointed, shared_folder, small, table

_WORDS = "regexp_split_to_array(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+')"
_SHINGLES = "CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END"


def _firsts(documents):
    """mark, doc_id, n of each distinct text that isn't blank: its least key, and how many rows hold that key and text."""
    d = documents.where(F.col("text").rlike(r"\S") & F.col("doc_id").isNotNull())
    each = d.groupBy(F.sha2("text", 256).alias("mark"), "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return checkpointed(each.groupBy("mark").agg(F.min(F.struct("doc_id", "n")).alias("d")).select("mark", "d.*"))


def _first_texts(documents, firsts):
    """The first document of each distinct text. Texts stay where they are while the firsts are few enough to be sent to them."""
    d = documents.select("doc_id", "text", F.sha2("text", 256).alias("mark"))
    d = d.join(small(firsts.select("doc_id", "mark"), 1_000_000), ["doc_id", "mark"], "left_semi")
    if not firsts.where("n > 1").isEmpty():  # rows that repeat whole
        d = d.dropDuplicates(["doc_id", "mark"])
    return d.select("doc_id", "text")


def _shingled(spark, sf_dir):
    """doc_id, s: the 5-word shingles of the first document of each distinct text."""
    d = table(spark, sf_dir, "documents")
    return S.token_sets(_first_texts(d, _firsts(d)), "doc_id", T.shingle_numbers(T.tokens(F.col("text"))))


@query(
    "near_dup_pairs",
    f"""WITH d AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 0 GROUP BY text),
    s AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM d)), f AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, count(*) AS i FROM f x JOIN f y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL)
    SELECT a, b, round(i / (n + m - i), 4) AS jaccard FROM p WHERE i / (n + m - i) >= 0.5""",
)
def near_dup_pairs(spark, sf_dir):
    """Different texts that share half of their 5-word shingles."""
    return S.jaccard_pairs(_shingled(spark, sf_dir), "doc_id", 0.5)


@query(
    "benchmark_overlap",
    f"""WITH b AS (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)), d AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
    x AS (SELECT item_id, len(s) AS n, unnest(s) AS t FROM b), y AS (SELECT doc_id, unnest(s) AS t FROM d)
    SELECT item_id, doc_id, count(*) AS shared, round(count(*) / n, 4) AS contained FROM x JOIN y USING (t) GROUP BY item_id, doc_id, n""",
)
def benchmark_overlap(spark, sf_dir):
    shingles = T.shingle_numbers(T.tokens(F.col("text")))
    b, d = S.token_sets(table(spark, sf_dir, "benchmark"), "item_id", shingles), S.token_sets(table(spark, sf_dir, "documents"), "doc_id", shingles)
    got = S.overlap_counts(b, d, "item_id", "doc_id")
    return got.select("item_id", "doc_id", "shared", F.round(F.col("shared") / F.col("size_a"), 4).alias("contained"))


@query("minhash_similarity")
def minhash_similarity(spark, sf_dir):
    """Estimated against exact similarity of near-duplicate pairs."""
    pairs = checkpointed(S.jaccard_pairs(_shingled(spark, sf_dir), "doc_id", 0.5))
    paired = small(checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()), 1_000_000)
    d = table(spark, sf_dir, "documents").join(paired, "doc_id", "left_semi")
    return S.estimated(pairs, checkpointed(S.sketched(d, "doc_id", T.shingle_hashes(T.tokens(F.col("text"))))), "doc_id")


@query(
    "hash_embedding",
    f"""WITH t AS (SELECT item_id, sha256(unnest({_WORDS})) AS h FROM benchmark),
    b AS (SELECT item_id, list_transform(range(1, 11), lambda i: instr('0123456789abcdef', h[i:i]) - 1) AS d FROM t),
    s AS (SELECT item_id, ((d[1] * 16 + d[2]) + (d[3] * 16 + d[4]) * 256 + (d[5] * 16 + d[6]) * 65536 + (d[7] * 16 + d[8]) * 16777216) % 128 AS place, sum(CASE WHEN d[10] % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM b GROUP BY ALL),
    n AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM s GROUP BY item_id)
    SELECT item_id, CAST(place AS INTEGER) AS place, round(v / norm, 6) AS value FROM s JOIN n USING (item_id) WHERE v <> 0""",
)
def hash_embedding(spark, sf_dir):
    return S.hash_embedding(table(spark, sf_dir, "benchmark"), "item_id", T.tokens(F.col("text")))


@query(
    "knn_top5",
    """WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
    p AS (SELECT query, vec_id AS vec, round(greatest(-1, least(1, list_cosine_similarity(q, CAST(embedding AS DOUBLE[])))), 4) AS cosine FROM q JOIN embeddings ON vec_id <> query),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, vec) AS rank FROM p) SELECT query, vec, cosine, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def knn_top5(spark, sf_dir):
    """Exact nearest vectors of the stated query set (ids divisible by 50) among all rows."""
    v = table(spark, sf_dir, "embeddings")
    return S.nearest(v.where("vec_id % 50 = 0"), v, "vec_id", "embedding", 5)


@query(
    "centroid_by_label",
    """WITH f AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings), m AS (SELECT label, place, avg(CAST(x AS DOUBLE)) AS m FROM f GROUP BY ALL),
    n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM m GROUP BY label) SELECT label, CAST(place AS INTEGER) AS place, round(m / norm, 4) AS value FROM m JOIN n USING (label)""",
)
def centroid_by_label(spark, sf_dir):
    return S.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")


@query(
    "candidate_union_cap",
    """WITH d AS (SELECT doc_id, source, lang, n_chars FROM documents), u AS (
      SELECT x.doc_id, y.doc_id AS candidate, 0 AS list, y.n_chars AS pos FROM d x JOIN d y ON x.source = y.source AND x.doc_id <> y.doc_id AND abs(x.n_chars - y.n_chars) <= 20
      UNION ALL SELECT x.doc_id, y.doc_id, 1, y.n_chars FROM d x JOIN d y ON x.lang = y.lang AND x.n_chars = y.n_chars AND x.doc_id <> y.doc_id),
    f AS (SELECT doc_id, candidate, min((list, pos)) AS spot FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot, candidate) AS rank FROM f)
    SELECT doc_id, candidate, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30""",
)
def candidate_union_cap(spark, sf_dir):
    """Two candidate lists in priority order, first occurrence kept, 30 an item: documents of the source with nearly the
    same length, then those of the language with the same length. What a document may see is made once for each length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    one = S.first_of_level(d, ["source"], "n_chars", "doc_id", 31, 20).withColumnRenamed("first", "one")
    two = S.first_of_level(d, ["lang"], "n_chars", "doc_id", 61).withColumnRenamed("first", "two")
    return S.first_of_lists(d.join(one, ["source", "n_chars"], "left").join(two, ["lang", "n_chars"], "left"), "doc_id", ["one", "two"])


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    y = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return c.select("conv_id", "turn", F.col("text").alias("a")).join(y, ["conv_id", "turn"])


_TURNS = "turns AS (SELECT x.conv_id, x.turn, x.text AS a, y.text AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"
_NUM = "list_distinct(regexp_extract_all({0}, '\\d+(?:[.,/]\\d+)*'))"
_WORD = "list_distinct(regexp_extract_all(lower({0}), '[a-z]{{3,}}'))"


def _overlap_sql(x, y):
    return f"CASE WHEN least(len({x}), len({y})) > 0 THEN len(list_intersect({x}, {y})) / least(len({x}), len({y})) ELSE 0.0 END"


@query(
    "pair_features",
    f"""WITH {_TURNS}, f AS (SELECT conv_id, turn, {_NUM.format('a')} AS na, {_NUM.format('b')} AS nb, {_WORD.format('a')} AS wa, {_WORD.format('b')} AS wb, length(a) AS la, length(b) AS lb FROM turns)
    SELECT conv_id, turn, round({_overlap_sql('na', 'nb')}, 4) AS number_overlap, round({_overlap_sql('wa', 'wb')}, 4) AS word_overlap,
      round(CASE WHEN len(list_distinct(list_concat(wa, wb))) > 0 THEN len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) ELSE 0.0 END, 4) AS jaccard,
      round(exp(-abs(la - lb) / 36.0), 4) AS time_proximity, coalesce(la > 0 AND lb > 0 AND least(la, lb) / greatest(la, lb) >= 0.95, false) AS near_length FROM f""",
)
def pair_features(spark, sf_dir):
    """Features of neighbouring turns; their lengths stand for hours here."""
    numbers = lambda c: F.array_distinct(T.found(F.col(c), T.NUMBER))
    words = lambda c: T.content_words(F.col(c))
    start = as_of()
    later = lambda c: F.timestamp_micros(F.unix_micros(start) + F.length(c).cast("long") * 3_600_000_000)
    return _turns(spark, sf_dir).select(
        "conv_id", "turn", F.round(N.overlap(numbers("a"), numbers("b")), 4).alias("number_overlap"), F.round(N.overlap(words("a"), words("b")), 4).alias("word_overlap"),
        F.round(N.jaccard(words("a"), words("b")), 4).alias("jaccard"), F.round(N.time_proximity(later("a"), later("b")), 4).alias("time_proximity"),
        M.near_identical_length(F.col("a"), F.col("b")).alias("near_length"),
    )


@query("pair_fuzzy")
def pair_fuzzy(spark, sf_dir):
    """Fuzzy ratios and the match decision of neighbouring whole turns; Python in Arrow batches."""
    a, b = F.col("a"), F.col("b")
    # A pair costs milliseconds, so the pairs of a small file are dealt out. Steps are columns, so that none is written out,
    # and done, once for each use.
    t = _turns(spark, sf_dir).repartition("conv_id", "turn").withColumn("s", fuzzy.scores(a, b))
    t = t.withColumn("x", T.content_words(a)).withColumn("y", T.content_words(b)).withColumn("semantic", N.jaccard(F.col("x"), F.col("y")))
    t = t.withColumn("swap", M.opposite_words(a, b, F.col("s.weighted")))
    t = t.withColumn("lexical", M.lexical(F.col("s.weighted"), F.col("s.token_set"), F.col("s.partial")))
    t = t.withColumn("matched", M.match_score(F.col("semantic"), F.col("lexical"), F.lit(0.5), F.lit(0.0), F.lit(1.0)))
    t = t.withColumn("score", M.vetoed(F.col("matched"), F.col("swap")))
    return t.select("conv_id", "turn", F.col("s.weighted").alias("title"), "s.token_set", "s.partial", "score", M.decision(F.col("score")).alias("decision"))


@query(
    "match_scores",
    """WITH s AS (SELECT doc_id, (doc_id % 101) / 100.0 AS sem, (doc_id % 37) / 36.0 AS lex, (doc_id % 11) / 10.0 AS tim, (doc_id % 3) / 2.0 AS met, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END AS lang FROM documents),
    m AS (SELECT doc_id, round(round(greatest(0, least(1, 0.45 * CASE lang WHEN 0.0 THEN least(sem, 0.95) WHEN 0.5 THEN least(sem, 0.9) ELSE sem END + 0.25 * CASE lang WHEN 0.0 THEN lex * 0.5 WHEN 0.5 THEN lex * 0.75 ELSE lex END + 0.15 * tim + 0.15 * met)), 9), 4) AS score FROM s)
    SELECT doc_id, score, CASE WHEN score >= 0.78 THEN 'match' WHEN score >= 0.52 THEN 'ambiguous' ELSE 'new_story' END AS decision FROM m""",
)
def match_scores(spark, sf_dir):
    k = F.col("doc_id")
    lang = F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 0.0).otherwise(0.5)
    score = M.match_score((k % 101) / 100, (k % 37) / 36, (k % 11) / 10, (k % 3) / 2, lang)
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score")).withColumn("decision", M.decision(F.col("score")))


@query(
    "independence_labels",
    """WITH m AS (SELECT d.doc_id, source, l.toxic, d.n_chars, max(d.n_chars) OVER (PARTITION BY source, lang) AS most FROM documents d LEFT JOIN labels l USING (doc_id)),
    f AS (SELECT doc_id, source, coalesce(toxic = 1, false) AS fwd, n_chars / most >= 0.95 AS near, doc_id % 5 = 0 AS url, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 9 AS DOUBLE) END AS gap FROM m)
    SELECT doc_id, CASE WHEN fwd THEN 'likely_copy' WHEN near AND (url OR coalesce(gap <= 3, false)) THEN 'likely_copy' WHEN near OR url THEN 'unknown' ELSE 'independent' END AS label,
      CASE WHEN fwd THEN 'forward_origin' WHEN near AND (url OR coalesce(gap <= 3, false)) THEN 'near_identical_plus_signal' WHEN near OR url THEN 'single_copy_signal' ELSE 'paraphrase_or_distinct' END AS reason FROM f""",
)
def independence_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", "i.label", "i.reason")


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    most = d.groupBy(F.col("source").alias("s"), F.col("lang").alias("l")).agg(F.max("n_chars").alias("most"))
    d = d.join(most, (F.col("source") == F.col("s")) & (F.col("lang") == F.col("l")))
    k = F.col("doc_id")
    gap = F.when(k % 2 == 0, (k % 9).cast("double"))
    return d.withColumn("i", M.independence(F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("n_chars") / F.col("most") >= 0.95, k % 5 == 0, gap))


@query(
    "independence_counts",
    """WITH m AS (SELECT d.doc_id, source, lang, l.toxic, d.n_chars, max(d.n_chars) OVER (PARTITION BY source, lang) AS most FROM documents d LEFT JOIN labels l USING (doc_id)),
    f AS (SELECT lang, source, CASE WHEN coalesce(toxic = 1, false) THEN 0 WHEN n_chars / most >= 0.95 AND (doc_id % 5 = 0 OR (doc_id % 2 = 0 AND doc_id % 9 <= 3)) THEN 0 WHEN n_chars / most >= 0.95 OR doc_id % 5 = 0 THEN 1 ELSE 2 END AS r FROM m),
    b AS (SELECT lang, source, max(r) AS r FROM f GROUP BY ALL) SELECT lang, count(*) AS observed, CAST(count(*) FILTER (WHERE r = 2) AS BIGINT) AS independent FROM b GROUP BY lang""",
)
def independence_counts(spark, sf_dir):
    """The best label of each source, then counts: languages stand for stories."""
    m = _labelled(spark, sf_dir).select("lang", "source", F.col("i.label").alias("label"))
    return M.independent_counts(M.per_source_label(m, "lang", "source", "label"), ["lang"], "label")


@query(
    "pair_evaluation",
    """WITH e AS (SELECT d.lang, quality = 1 AS same, n_chars > 1500 AS pred FROM labels JOIN documents d USING (doc_id)),
    c AS (SELECT lang, count(*) FILTER (WHERE same AND pred) AS tp, count(*) FILTER (WHERE NOT same AND pred) AS fp, count(*) FILTER (WHERE NOT same AND NOT pred) AS tn, count(*) FILTER (WHERE same AND NOT pred) AS fn FROM e GROUP BY lang)
    SELECT lang, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS precision,
      round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS f1,
      round(fp / (tp + fp + tn + fn), 4) AS false_merge_rate, round(fn / (tp + fp + tn + fn), 4) AS false_split_rate FROM c""",
)
def pair_evaluation(spark, sf_dir):
    e = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id").where(F.col("quality").isNotNull())
    return M.evaluate(e, ["lang"], F.col("quality") == 1, F.col("n_chars") > 1500)


@query(
    "primary_member",
    """WITH m AS (SELECT d.doc_id, lang, quality, n_chars, row_number() OVER (PARTITION BY lang ORDER BY (quality IS NOT NULL) DESC, doc_id % 50, coalesce(quality, 0) DESC, n_chars DESC, d.doc_id) AS n FROM documents d LEFT JOIN labels USING (doc_id))
    SELECT lang, doc_id, n_chars FROM m WHERE n = 1""",
)
def primary_member(spark, sf_dir):
    m = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    got = M.primary_member(m, "lang", F.col("quality").isNotNull(), F.col("doc_id") % 50, F.coalesce("quality", F.lit(0)), F.col("n_chars"), "doc_id")
    return got.select("lang", "doc_id", "n_chars")


@query(
    "best_candidate",
    "SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey",
)
def best_candidate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return M.best_candidate(o, "o_custkey", "o_totalprice", "o_orderkey")


@query("sketch_candidates")
def sketch_candidates(spark, sf_dir):
    """For each document the 15 others that are most like it by MinHash, from those that share a band."""
    d = table(spark, sf_dir, "documents")
    sketched = S.sketched(d, "doc_id", T.shingle_hashes(T.tokens(F.col("text"))), 64)
    return lsh.most_alike(*lsh.banded(sketched, "doc_id", "sketch", 16, 4, 0.3), 15).withColumnRenamed("key", "doc_id")


@query(
    "vector_search",
    """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_reverse(CAST(embedding AS DOUBLE[])) ELSE CAST(embedding AS DOUBLE[]) END AS x,
        CASE WHEN vec_id % 7 = 0 THEN 'again' WHEN vec_id % 9 = 0 THEN 'late' ELSE 'first' END AS payload FROM embeddings WHERE vec_id % 11 <> 0),
    q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
    p AS (SELECT query, vec_id AS key, payload, round(greatest(-1, least(1, list_cosine_similarity(q, x))), 4) AS score FROM q, v),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM p) SELECT query, key, payload, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30 AND score >= 0.1""",
)
def vector_search(spark, sf_dir):
    """A collection of the vectors, with later additions, replacements and deletions, asked for the nearest of every 50th."""
    v = table(spark, sf_dir, "embeddings")
    kept = Collection(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", Identity("given", "tables/embeddings", "1", 64))
    kept.create(v.where("vec_id % 9 <> 0"), "vec_id", "embedding", F.lit("first"), cells=32)
    kept.upsert(v.where("vec_id % 9 = 0"), "vec_id", "embedding", F.lit("late"))
    kept.upsert(v.where("vec_id % 7 = 0").withColumn("embedding", F.reverse("embedding")), "vec_id", "embedding", F.lit("again"))
    kept.delete(v.where("vec_id % 11 = 0"), "vec_id")
    return kept.search(v.where("vec_id % 50 = 0"), "vec_id", "embedding", least=0.1)
