"""Query op9: all documents in shards 0 to 39 under the law `key`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.llm.sharding import shard

SHARDS = 40


def op9_sharding(spark, sf_dir):
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: CRC-32 by the table method over the UTF-8 bytes, jumps in 128-bit numbers, slots by bucket, key, size and crc.
ORACLES = {
    "op9_sharding": r"""
    WITH RECURSIVE t8(i, k, c) AS (SELECT range, 0, range::BIGINT FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t8 WHERE k < 8),
    tab AS (SELECT list(c ORDER BY i) AS t FROM t8 WHERE k = 8),
    h AS (SELECT row_number() OVER () AS rn, doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents),
    c AS (SELECT rn, doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(x, lambda b: ('0x' || b)::BIGINT)), lambda a, b: xor(a >> 8, t[1 + xor(a & 255, b)])), 4294967295) AS crc FROM h, tab),
    j(rn, key, b, j) AS (SELECT rn, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616, -1::BIGINT, 0::BIGINT FROM c
      UNION ALL SELECT rn, n, j, floor((j + 1) * (2147483648.0::DOUBLE / ((n // 8589934592) + 1)::DOUBLE))::BIGINT FROM (SELECT rn, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS n FROM j WHERE j < 40)),
    s AS (SELECT doc_id, size::BIGINT AS size, crc, j.b::INTEGER AS shard, CASE WHEN j.j = 40 THEN 40 ELSE j.b END::INTEGER AS grown_shard FROM c JOIN j USING (rn) WHERE j.j >= 40)
    SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard,
      row_number() OVER (PARTITION BY shard ORDER BY ((coalesce(doc_id, 0) % 1024 + 1024) % 1024 + crc % 1024) % 1024, doc_id NULLS FIRST, size, crc) - 1 AS slot, grown_shard FROM s
    """
}
QUERIES = {"op9_sharding": op9_sharding}
