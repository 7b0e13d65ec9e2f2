import zlib
from collections import Counter

from tidewire.llm.sharding import shard


def jump(key, n):
    key %= 2**64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def rows(spark, n=400):
    data = [(i * 7919 - 300, None if i % 50 == 0 else "é" * (i % 5), "x") for i in range(n)]
    data += [(5, "same", "x")] * 9 + [(None, None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, shard string")


def test_matches_published_algorithm(spark):
    for r in shard(rows(spark), 40).collect():
        key = r.doc_id or 0
        assert (r.shard, r.grown_shard) == (jump(key, 40), jump(key, 41))
        assert r.grown_shard in (r.shard, 40)


def test_slots_are_gapless_and_rows_whole(spark):
    df = rows(spark)
    got = shard(df, 7).collect()
    assert len(got) == df.count()
    for k, n in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
    text = {r.doc_id: r.text or "" for r in df.collect()}
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())


def test_empty_table(spark):
    assert shard(rows(spark).limit(0), 40).count() == 0


def test_equals_the_sql(spark):
    import duckdb

    from tidewire.llm.q_sharding import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(ORACLES["op9_sharding"])
    got = QUERIES["op9_sharding"](spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
