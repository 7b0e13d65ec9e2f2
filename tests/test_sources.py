import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewire.sources import addresses, feeds, messages, pages, registry
from tidewire.streaming import jobs

RSS = """<rss version="2.0"><channel><title>c</title>
<item><title>A</title><link>https://e.com/a</link><guid>g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description><![CDATA[<p>x</p>]]></description><enclosure url="https://e.com/i.jpg" length="5" type="image/jpeg"/></item>
<item><title>B</title><link>https://e.com/b</link><description>y</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>E</title><link href="https://e.com/e"/><id>u1</id><updated>2024-01-02T03:04:05Z</updated><author><name>N</name></author><summary>s</summary></entry></feed>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "r.xml").write_text(RSS)
    (tmp_path / "a.xml").write_text(ATOM)
    a, b = registry.reader("rss", "any")(spark, str(tmp_path / "r.xml")).orderBy("title").collect()
    assert a.external_id == "g1" and a.published_at == dt.datetime(2024, 1, 1, 10) and a.media[0].url.endswith("i.jpg") and "<p>" in a.text
    assert b.external_id == "https://e.com/b" and b.published_at is None and b.media is None
    e = registry.reader("rss", "atom")(spark, str(tmp_path / "a.xml")).head()
    assert (e.external_id, e.url, e.text, e.author) == ("u1", "https://e.com/e", "s", "N")
    with pytest.raises(KeyError):
        registry.reader("unknown")


def test_messages_and_posts(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"id":30,"date":"2024-01-01T00:00:00Z","text":"hi","views":5,"reactions":[{"label":"+","count":2}]}\n{"id":31,"date":"2024-01-01T00:00:00Z","service":"joined"}\n{"id":30,"date":"2024-01-01T00:00:00Z","edit_date":"2024-01-02T00:00:00Z","text":"edited","views":-1}\n{"id":2,"date":"2024-01-01T00:00:00Z","text":"old"}\n')
    got = messages.read_messages(spark, str(tmp_path / "m.json"), "chan", after=40).collect()
    assert [(r.external_id, r.text, r.views, r.reactions, r.url) for r in got] == [("30", "edited", None, None, "https://t.me/chan/30")]
    (tmp_path / "p.json").write_text('{"id":"7","text":"t","author":{"username":"u"},"public_metrics":{"retweet_count":"3","like_count":"-1"}}\n')
    p = messages.read_posts(spark, str(tmp_path / "p.json")).head()
    assert (p.forwards, p.shares, p.reactions, p.views) == (3, 3, None, None)


def test_pages_and_addresses(spark):
    title, text = pages.read_page("<title>T</title><nav><p>n</p></nav><main><article><p>a b</p><p>c</main><p>out</p>")
    assert (title, text) == ("T", "a b\n\nc")
    ip = spark.range(1).select(addresses.ip_number(F.lit("10.1.2.3")).alias("ip"))
    assert addresses.refused(ip, "ip").head().refused == "private10"
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    wait = spark.range(1).select(addresses.retry_after(F.lit("120"), now).alias("a"), addresses.retry_after(F.lit("Mon, 01 Jan 2024 00:10:00 GMT"), now).alias("b"), addresses.retry_after(F.lit("x"), now).alias("c")).head()
    assert (wait.a, wait.b, wait.c) == (120, 600, None)


def test_stream_intake_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, src string, ext string"
    spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x")], schema).coalesce(1).write.parquet(src)
    for name in ("c1", "c2"):  # a second run from the start adds nothing
        jobs.intake_query(jobs.stream(spark, src, schema), out, str(tmp_path / name), "src", ["ext"], "id").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 3]
