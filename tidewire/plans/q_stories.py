"""Stories from their members, and publications."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewire.functions import numbers as N
from tidewire.functions import text as T
from tidewire.operators import publishing as P
from tidewire.operators import stories as ST
from tidewire.plans.base import AS_OF, STORIES, as_of, events, members, query, stories
from tidewire.sources.addresses import ip_number, refused
from tidewire.session import table

_M = "m AS (SELECT *, event_id * 7919 % 997 AS story_id FROM events)"
_TIMES = """t AS (SELECT event_id, event_id * 7919 % 997 AS story_id, user_id, value, ts, CASE WHEN event_id % 9 > 0 THEN ts END AS published, CASE WHEN event_id % 4 > 0 THEN ts + to_hours(event_id % 5) END AS updated FROM events)"""


def _times(spark, sf_dir):
    later = F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 5).cast("int"))
    published, updated = F.when(F.col("event_id") % 9 > 0, F.col("ts")), F.when(F.col("event_id") % 4 > 0, later)
    return members(spark, sf_dir).withColumns({"published": published, "updated": updated})


@query("effective_times", f"WITH {_TIMES} SELECT event_id, epoch_us(greatest(published, updated)) AS effective FROM t")
def effective_times(spark, sf_dir):
    return _times(spark, sf_dir).select("event_id", F.unix_micros(ST.effective_time(F.col("published"), F.col("updated"))).alias("effective"))


@query("story_times", f"WITH {_TIMES} SELECT story_id, epoch_us(min(published)) AS first, epoch_us(max(greatest(published, updated))) AS latest FROM t GROUP BY story_id")
def story_times(spark, sf_dir):
    got = ST.story_times(_times(spark, sf_dir), "story_id", F.col("published"), F.col("updated"))
    return got.select("story_id", F.unix_micros("first").alias("first"), F.unix_micros("latest").alias("latest"))


@query(
    "nearest_time_gap",
    f"""WITH {_TIMES} SELECT a.event_id, round(min(abs(epoch_us(a.published) - epoch_us(b.published))) / 3.6e9, 4) AS gap_hours FROM t a LEFT JOIN t b ON a.story_id = b.story_id AND a.event_id <> b.event_id GROUP BY a.event_id""",
)
def nearest_time_gap(spark, sf_dir):
    return ST.nearest_gap_hours(_times(spark, sf_dir), "story_id", "published").select("event_id", "gap_hours")


@query(
    "representative_members",
    f"""WITH {_TIMES}, r AS (SELECT story_id, event_id, row_number() OVER (PARTITION BY story_id ORDER BY event_id % 6 = 0 DESC, updated DESC NULLS LAST, ts DESC, event_id) AS rank FROM t) SELECT story_id, event_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""",
)
def representative_members(spark, sf_dir):
    m = _times(spark, sf_dir).withColumn("is_primary", F.col("event_id") % 6 == 0)
    return ST.representatives(m, "story_id", "is_primary", "updated", "ts", "event_id").select("story_id", "event_id", "rank")


@query(
    "story_shingle_union",
    """WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM conversations WHERE turn < 8),
    s AS (SELECT conv_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS x FROM w),
    l AS (SELECT conv_id, list_sort(list(DISTINCT x))[1:2000] AS x FROM s GROUP BY conv_id)
    SELECT conv_id, CAST(len(x) AS INTEGER) AS n, sha256(array_to_string(x, chr(10))) AS digest FROM l""",
)
def story_shingle_union(spark, sf_dir):
    """The shingles of a conversation's first eight turns, sorted, the first 2,000 of them."""
    m = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("rank"), T.shingles(T.tokens(F.col("text"))).alias("s"))
    got = ST.union_of_arrays(m, "conv_id", "rank", "s", 8, 2000)
    return got.select("conv_id", F.size("values").alias("n"), F.sha2(F.array_join("values", "\n"), 256).alias("digest"))


@query("member_metric_max", f"WITH {_M} SELECT story_id, max(CASE WHEN event_type = 'view' THEN value END) AS views, max(CASE WHEN event_type = 'click' THEN value END) AS clicks FROM m GROUP BY story_id")
def member_metric_max(spark, sf_dir):
    m = members(spark, sf_dir).select("story_id", *[F.when(F.col("event_type") == e, F.col("value")).alias(f"{e}s") for e in ("view", "click")])
    return ST.metric_maxima(m, "story_id", ["views", "clicks"])


@query("source_diversity", f"WITH {_M} SELECT story_id, round(least(1.0, count(DISTINCT user_id) / count(*)), 4) AS source_diversity, round(least(1.0, count(DISTINCT event_type) / 4), 4) AS platform_diversity FROM m GROUP BY story_id")
def source_diversity(spark, sf_dir):
    return ST.diversity(members(spark, sf_dir), "story_id", "user_id", "event_type")


@query(
    "ranking_momentum",
    f"""WITH {_M}, r AS (SELECT story_id, coalesce(avg(CASE WHEN event_type = 'view' THEN value / 377 END), 0.5) AS r, coalesce(max(CASE WHEN event_type <> 'error' THEN greatest(0, least(1, value / 500)) END), 0.2) AS v,
      coalesce(max(CASE WHEN event_type = 'click' THEN greatest(0, least(1, (value - 50) / 100)) END), 0.2) AS a, round(1 - exp(-0.7 * (story_id % 4)), 4) AS s, CASE WHEN story_id % 5 = 0 THEN 0.2 ELSE 0.85 END AS c FROM m GROUP BY story_id)
    SELECT story_id, round(r, 4) AS relative_performance, round(v, 4) AS engagement_velocity, round(a, 4) AS engagement_acceleration, s AS spread, CAST(c AS DOUBLE) AS consistency, round(0.4 * r + 0.2 * v + 0.1 * a + 0.2 * s + 0.1 * c, 4) AS momentum FROM r""",
)
def ranking_momentum(spark, sf_dir):
    e, v = F.col("event_type"), F.col("value")
    m = members(spark, sf_dir).select("story_id", F.when(e == "view", v / 377).alias("r"), F.when(e != "error", v).alias("v"), F.when(e == "click", v - 50).alias("a"))
    return ST.ranking_momentum(m, "story_id", "r", "v", "a", F.col("story_id") % 4, F.col("story_id") % 5 == 0)


@query("time_to_double", "SELECT event_id, CASE WHEN event_id % 37 > 10 AND value * 3 > 50 THEN round(value * 3 / (event_id % 37) * 3600, 1) END AS seconds FROM events")
def time_to_double(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", ST.time_to_double(F.col("value") * 3, F.col("event_id") % 37).alias("seconds"))


@query(
    "single_snapshot_series",
    f"""WITH s AS (SELECT user_id * 31 + event_id % 31 AS item, count(*) AS n, arg_max(value, ts) / 500 AS blend FROM events GROUP BY 1)
    SELECT item, round(blend, 4) AS normalized, round(blend, 4) AS ewma, CAST(NULL AS DOUBLE) AS acceleration FROM s WHERE n = 1""",
)
def single_snapshot_series(spark, sf_dir):
    """Items of one snapshot: its standing serves as velocity and average, and there is no acceleration."""
    s = events(spark, sf_dir).groupBy((F.col("user_id") * 31 + F.col("event_id") % 31).alias("item")).agg(F.count(F.lit(1)).alias("n"), F.max_by("value", "ts").alias("v"))
    blend = F.round(F.col("v") / 500, 4)
    return s.where("n = 1").select("item", blend.alias("normalized"), blend.alias("ewma"), F.lit(None).cast("double").alias("acceleration"))


@query(
    "relative_performance",
    """WITH f AS (SELECT user_id, min(ts) AS first FROM events GROUP BY user_id), a AS (SELECT e.user_id, e.event_type, e.value, (epoch_us(ts) - epoch_us(first)) / 6e7 AS age, event_id FROM events e JOIN f USING (user_id)),
    n AS (SELECT user_id, event_type, arg_min(value, (abs(age - 60), event_id)) AS v FROM a WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id, event_type),
    b AS (SELECT event_type, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY event_type),
    s AS (SELECT user_id, event_type, CASE WHEN v <= p25 THEN 0.25 WHEN v <= p50 THEN 0.5 WHEN v <= p75 THEN 0.75 WHEN v <= p90 THEN 0.9 ELSE 0.99 END AS p, CASE event_type WHEN 'view' THEN 0.4 WHEN 'click' THEN 0.3 ELSE 0.15 END AS w FROM n JOIN b USING (event_type))
    SELECT user_id, round(sum(p * w) / sum(w), 4) AS relative FROM s GROUP BY user_id""",
)
def relative_performance(spark, sf_dir):
    """Of each source the metrics at 60 minutes, against the table's percentiles, blended by the weights of those known."""
    e = events(spark, sf_dir)
    first = e.groupBy("user_id").agg(F.min("ts").alias("first"))
    age = (F.unix_micros("ts") - F.unix_micros("first")) / 6e7
    near = e.where(F.col("event_type").isin("view", "click", "purchase")).join(first, "user_id")
    near = near.groupBy("user_id", "event_type").agg(F.min_by("value", F.struct(F.abs(age - 60), "event_id")).alias("v"))
    base = e.groupBy("event_type").agg(*[F.percentile("value", q).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75, 0.9)])
    v = F.col("v")
    step = F.when(v <= F.col("p25"), 0.25).when(v <= F.col("p50"), 0.5).when(v <= F.col("p75"), 0.75).when(v <= F.col("p90"), 0.9).otherwise(0.99)
    weight = F.when(F.col("event_type") == "view", 0.4).when(F.col("event_type") == "click", 0.3).otherwise(0.15)
    got = near.join(F.broadcast(base), "event_type").groupBy("user_id").agg((F.sum(step * weight) / F.sum(weight)).alias("r"))  # one row a metric
    return got.select("user_id", F.round("r", 4).alias("relative"))


@query("health_counts", f"WITH {STORIES} SELECT CAST(count(*) FILTER (WHERE status = 'active') AS BIGINT) AS active, CAST(count(*) FILTER (WHERE status = 'breaking') AS BIGINT) AS breaking, CAST(count(*) FILTER (WHERE status = 'rising') AS BIGINT) AS rising, CAST(count(*) FILTER (WHERE status = 'watching') AS BIGINT) AS watching FROM stories")
def health_counts(spark, sf_dir):
    return stories(spark, sf_dir).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("active", "breaking", "rising", "watching")])


@query(
    "refresh_chunks",
    """WITH r AS (SELECT event_type, user_id, event_id, (row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1) // 100 AS chunk FROM events)
    SELECT event_type, user_id, CAST(chunk AS INTEGER) AS chunk, count(*) AS n, min(event_id) AS first FROM r GROUP BY ALL""",
)
def refresh_chunks(spark, sf_dir):
    """Messages to refresh, by account and peer, a hundred at a time."""
    n = F.row_number().over(W.partitionBy("event_type", "user_id").orderBy("event_id"))
    e = events(spark, sf_dir).withColumn("chunk", F.floor((n - 1) / 100).cast("int"))
    return e.groupBy("event_type", "user_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query("preference_values", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 0.5 ELSE round(greatest(0, least(1, value / 100 - 0.2)), 6) END AS preference FROM events")
def preference_values(spark, sf_dir):
    """Preferences within 0 to 1; one half where a value is missing or no number."""
    raw = F.when(F.col("event_id") % 6 != 0, F.col("value") / 100 - 0.2).when(F.col("event_id") % 12 == 0, F.lit(float("nan")))
    return events(spark, sf_dir).select("event_id", N.preference(raw).alias("preference"))


@query(
    "weights_of_run",
    """SELECT o_orderpriority AS name, round(count(*) / sum(count(*)) OVER (), 4) AS weight FROM orders GROUP BY o_orderpriority""",
)
def weights_of_run(spark, sf_dir):
    """Weights that add up to one."""
    w = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("name", N.share(F.col("n")).alias("weight"))


@query(
    "shared_address_candidates",
    """WITH p AS (SELECT page_id, page_id % 20 AS story, regexp_replace(url, '[?#].*$', '') AS u, regexp_replace(regexp_extract(url, '//([^/?#]+)', 1), '^www\\.', '') AS h FROM pages),
    i AS (SELECT * FROM p WHERE page_id % 3 = 0), s AS (SELECT * FROM p WHERE page_id % 3 > 0)
    SELECT DISTINCT i.page_id, s.story FROM i JOIN s ON (i.u = s.u OR (i.h = s.h AND i.page_id % 2 = 0)) AND i.story <> s.story""",
)
def shared_address_candidates(spark, sf_dir):
    """Stories that share a page's address, or its host if the page gives addresses; its own story is left out."""
    address = F.array(F.regexp_replace("url", r"[?#].*$", ""))
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 20).alias("story"), address.alias("urls"), F.array(T.host(F.col("url"))).alias("domains"))
    # Of pages with odd numbers the address is known to the story side only; they are candidates by address alone.
    i = p.where("page_id % 3 = 0").withColumnRenamed("story", "own")
    even = ST.shared_address_candidates(i.where("page_id % 2 = 0"), p.where("page_id % 3 > 0"), "page_id", "story", "own")
    odd = ST.shared_address_candidates(i.where("page_id % 2 = 1").withColumn("domains", F.array().cast("array<string>")), p.where("page_id % 3 > 0"), "page_id", "story", "own")
    return even.unionByName(odd)


@query("double_assignments", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1")
def double_assignments(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "P").alias("is_current"))
    return ST.double_assignments(o, "o_custkey", "is_current")


@query(
    "news_values",
    "SELECT l_orderkey, l_linenumber, round((l_discount * 10 + l_tax * 10 + l_quantity / 50 + 0.5 + 0.7 + 0.5) / 6, 4) AS news_value FROM lineitem",
)
def news_values(spark, sf_dir):
    parts = [F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.lit(0.5), F.lit(0.7), F.lit(0.5)]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ST.news_value(parts).alias("news_value"))


@query(
    "publication_fingerprints",
    """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE trim(role) END AS h, CASE WHEN turn % 6 = 0 THEN ' ' ELSE role END AS c FROM conversations)
    SELECT conv_id, turn, CASE WHEN coalesce(h, '') <> '' OR trim(c) <> '' THEN sha256('{"content":' || to_json(trim(c)) || ',"emoji_level":0,"headline":' || to_json(coalesce(h, '')) || ',"selected_media_id":null,"tone":"neutral","version":' || (turn + 1) || '}') END AS fingerprint FROM c""",
)
def publication_fingerprints(spark, sf_dir):
    headline = F.when(F.col("turn") % 3 != 0, F.col("role"))
    content = F.when(F.col("turn") % 6 == 0, " ").otherwise(F.col("role"))
    more = {"emoji_level": F.lit(0), "selected_media_id": F.lit(None).cast("long"), "tone": F.lit("neutral"), "version": F.col("turn") + 1}
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.fingerprint(headline, content, **more).alias("fingerprint"))


@query("context_hashes", """SELECT c_custkey, sha256('{"nation":' || c_nationkey || ',"segment":' || to_json(c_mktsegment) || '}') AS context FROM customer""")
def context_hashes(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", P.canonical_hash(segment=F.col("c_mktsegment"), nation=F.col("c_nationkey")).alias("context"))


@query("media_once", "SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey, l_returnflag, l_shipdate")
def media_once(spark, sf_dir):
    """Media of an item by the hash of item, address and file: the first of each."""
    h = F.sha2(F.concat_ws(":", F.col("l_orderkey").cast("string"), "l_returnflag", F.col("l_shipdate").cast("string")), 256)
    m = table(spark, sf_dir, "lineitem").withColumn("h", h)
    return m.groupBy("l_orderkey", "h").agg(F.min("l_linenumber").alias("l_linenumber")).drop("h")


@query(
    "version_faults",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'no key' WHEN o_orderkey % 5 < 1 THEN 'version below 1' WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 5 <> 1 THEN 'initial with a later version' END AS fault FROM orders""",
)
def version_faults(spark, sf_dir):
    key = F.when(F.col("o_orderkey") % 17 != 0, "k")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "initial").otherwise("material_update")
    return table(spark, sf_dir, "orders").select("o_orderkey", P.version_fault(key, F.col("o_orderkey") % 5, kind).alias("fault"))


@query(
    "next_versions",
    "SELECT conv_id, CAST(greatest(2, max(turn) + 1) AS INTEGER) AS next_version, max(turn) AS parent FROM conversations GROUP BY conv_id",
)
def next_versions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("key"))
    return P.next_versions(c, "conv_id", "turn", "key")


@query(
    "follow_up_chain",
    "SELECT a.conv_id, a.turn, b.role AS parent_role FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1",
)
def follow_up_chain(spark, sf_dir):
    """Each post with the one that it follows up."""
    c = table(spark, sf_dir, "conversations")
    parent = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"))
    return c.select("conv_id", "turn").join(parent, ["conv_id", "turn"], "left")


@query(
    "config_overrides",
    """SELECT p_partkey, CAST(coalesce(CASE p_brand WHEN 'Brand#11' THEN 0.9 WHEN 'Brand#12' THEN 0.1 END, 0.5) AS DOUBLE) AS weight FROM part""",
)
def config_overrides(spark, sf_dir):
    """Settings from a table, with a default where there is none; the settings are a fixed few rows."""
    settings = spark.createDataFrame([("Brand#11", 0.9), ("Brand#12", 0.1)], "p_brand string, weight double")
    return table(spark, sf_dir, "part").join(F.broadcast(settings), "p_brand", "left").select("p_partkey", F.coalesce("weight", F.lit(0.5)).alias("weight"))


@query("preference_lookup", "SELECT c_custkey, coalesce(CASE WHEN n > 2 THEN round(p, 4) END, 0.5) AS preference FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, avg(o_totalprice) / 1000000 AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey")
def preference_lookup(spark, sf_dir):
    """A preference where there are samples enough, else one half."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), (F.avg("o_totalprice") / 1_000_000).alias("p"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce(F.when(F.col("n") > 2, F.round("p", 4)), F.lit(0.5)).alias("preference"))


@query(
    "media_faults",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 AND l_returnflag = 'A' THEN '' WHEN l_returnflag = 'A' THEN 'missing_url' WHEN l_suppkey % 10 = 0 THEN 'refused_address' WHEN l_linestatus = 'F' AND l_linenumber % 2 = 0 THEN 'unsupported_mime:text/html' WHEN l_quantity > 45 THEN 'file_too_large' ELSE '' END AS fault FROM lineitem""",
)
def media_faults(spark, sf_dir):
    """Why an asset can't be sent: no address, an address that must not be fetched, type or size."""
    li = table(spark, sf_dir, "lineitem").withColumn("address", F.when(F.col("l_suppkey") % 10 == 0, "10.1.2.3").otherwise("93.184.216.34"))
    li = refused(li.withColumn("ip", ip_number(F.col("address"))), "ip")
    url = F.when(F.col("l_returnflag") != "A", F.concat(F.lit("https://"), "address"))
    kind = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 2 == 0), "text/html").when(F.col("l_linenumber") != 3, "image/png")
    native = F.when(F.col("l_linenumber") == 1, "id")
    fault = P.media_fault(native, url, F.col("refused").isNotNull(), kind, F.when(F.col("l_quantity") > 45, P.LARGEST_MEDIA + 1).otherwise(1000))
    return li.select("l_orderkey", "l_linenumber", fault.alias("fault"))


@query(
    "story_media",
    """WITH m AS (SELECT o_custkey AS story, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN l_linenumber <> 4 THEN l_quantity END DESC NULLS LAST, l_tax DESC NULLS LAST, l_orderkey * 10 + l_linenumber) AS rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')
    SELECT story, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM m WHERE rank <= 5""",
)
def story_media(spark, sf_dir):
    """Media of items of current memberships of stories: the five largest of each story."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"))
    m = li.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("story"), "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 4, F.col("l_quantity")).alias("width"), F.col("l_tax").alias("height"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key")
    )
    return P.best_media(m, "story", "width", "height", "key").select("story", "l_orderkey", "l_linenumber", "rank")


@query(
    "what_and_how",
    """SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'hold' WHEN conv_id % 3 < 1 THEN 'hold' WHEN (turn % 4) / 3.0 < 0.45 THEN 'skip' WHEN (turn % 4) / 3.0 >= 0.7 THEN 'publish' ELSE 'schedule' END AS action, CAST(CASE WHEN length(role) + length(text) > 1500 THEN 3 ELSE 2 END AS INTEGER) AS depth FROM conversations""",
)
def what_and_how(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    action = P.what(F.when(F.col("turn") % 5 == 4, "low_credibility"), F.col("conv_id") % 3, (F.col("turn") % 4) / 3.0)
    return c.select("conv_id", "turn", action.alias("action"), P.depth(F.col("role"), F.col("text")).alias("depth"))


@query("post_snapshots", "SELECT o_orderkey, epoch_us(o_orderdate) AS captured, CAST(NULL AS BIGINT) AS views, CAST(NULL AS BIGINT) AS forwards FROM orders WHERE o_orderstatus = 'F'")
def post_snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumn("at", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return P.empty_snapshots(o, "o_orderkey", "at", ["views", "forwards"]).withColumnRenamed("captured_at", "captured")


@query(
    "unposted_drafts",
    """SELECT DISTINCT 'story-' || o_custkey || '-v2-' || substr(sha256('{"status":' || to_json(o_orderstatus) || '}'), 1, 16) AS key FROM orders WHERE o_orderkey % 2 = 0 AND (o_custkey, o_orderstatus) NOT IN (SELECT (o_custkey, o_orderstatus) FROM orders WHERE o_orderkey % 2 = 1)""",
)
def unposted_drafts(spark, sf_dir):
    """Drafts whose key no earlier post has, once each."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", P.post_key(F.col("o_custkey"), F.lit(2), P.canonical_hash(status=F.col("o_orderstatus"))).alias("key"))
    return P.not_yet_posted(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "key").select("key")


@query(
    "signatures",
    """SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN trim('------------' || chr(10) || CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'text' END) ELSE '' END AS signature FROM supplier""",
)
def signatures(spark, sf_dir):
    text = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("text")
    return table(spark, sf_dir, "supplier").select("s_suppkey", P.signature(F.col("s_acctbal") > 0, text, F.col("s_name")).alias("signature"))


@query("filled_prompts", "SELECT n_nationkey, 'Name ' || n_name || ' of ' || n_regionkey || ', ' || n_name || '.' AS prompt FROM nation")
def filled_prompts(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", P.fill("Name __NAME__ of __REGION__, __NAME__.", NAME=F.col("n_name"), REGION=F.col("n_regionkey").cast("string")).alias("prompt"))


@query(
    "media_kinds",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'photo' WHEN 'click' THEN 'video' WHEN 'error' THEN 'document' ELSE CASE WHEN event_id % 2 = 0 THEN 'audio' END END AS kind FROM events""",
)
def media_kinds(spark, sf_dir):
    e = F.col("event_type")
    declared = F.when(e == "view", "MessageMediaPhoto").when(e == "click", "VideoFile").when(e == "error", "Unknown")
    kinds = ["photo", "video", "document", "audio", "voice", "animation", "poll", "sticker"]
    return events(spark, sf_dir).select("event_id", P.media_kind(kinds, {"audio": F.when(F.col("event_id") % 2 == 0, "a")}, declared).alias("kind"))


@query("reply_counts", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 7 WHEN event_id % 5 = 0 THEN event_id % 11 END AS replies FROM events")
def reply_counts(spark, sf_dir):
    """The first usable number of several places: negative ones and truth values are none."""
    from tidewire.sources.messages import first_count

    i = F.col("event_id")
    doc = F.when(i % 3 == 0, F.format_string('{"replies": {"count": %d, "reply_count": true}}', i % 7)).when(i % 5 == 0, F.format_string('{"replies": {"count": -1}, "reply_info": {"reply_count": %d}}', i % 11)).otherwise('{"replies": null}')
    places = [f"$.{a}.{b}" for a in ("replies", "reply_info") for b in ("replies_count", "reply_count", "count")]
    return events(spark, sf_dir).select("event_id", first_count(doc, places).alias("replies"))


@query(
    "cached_results",
    """WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT user_id, ts AS stored, value FROM events WHERE event_type = 'purchase')
    SELECT event_id, arg_max(value, stored) AS value FROM q LEFT JOIN r ON q.user_id = r.user_id AND stored <= ts AND stored >= ts - INTERVAL 24 HOUR GROUP BY event_id""",
)
def cached_results(spark, sf_dir):
    """Results that are at most a day old when asked for."""
    e = events(spark, sf_dir)
    asked = e.where("event_type = 'signup'").select("event_id", "user_id", "ts")
    stored = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("stored"), "value")
    return P.cached(asked, stored, "user_id", "ts", "stored", 24).select("event_id", F.col("result.value").alias("value"))
