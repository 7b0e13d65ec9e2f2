"""Jump consistent hashing in DataFrame expressions.

The published algorithm (Lamping & Veach, 2014): a 64-bit linear congruential generator seeded with the key yields an
increasing sequence of jumps b -> floor((b + 1) * 2^31 / ((key >> 33) + 1)); the last value below the shard count is the
shard. No ring table is kept, and one more shard takes keys from all others and moves none between them.

Spark's long arithmetic is checked for overflow, so the product modulo 2^64 is put together from 16-bit limbs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import dense_rank_offsets

# Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF

BUCKETS = 1024  # of a shard's rows while slots are handed out


def _next_key(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2^64, as a signed long."""
    c = [(MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]
    lo, hi = key.bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(key, 32)
    mid = lo * F.lit(c[1])
    low = lo * F.lit(c[0]) + F.shiftleft(mid.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    high = (
        F.shiftrightunsigned(low, 32)
        + F.shiftrightunsigned(mid, 16)
        + lo * F.lit(c[2])
        + F.shiftleft((lo * F.lit(c[3])).bitwiseAND(F.lit(0xFFFF)), 16)
        + hi * F.lit(c[0])
        + F.shiftleft((hi * F.lit(c[1])).bitwiseAND(F.lit(0xFFFF)), 16)
    )
    return F.shiftleft(high.bitwiseAND(F.lit(LOW32)), 32).bitwiseOR(low.bitwiseAND(F.lit(LOW32)))


def jumps(key: Column, shards: int) -> Column:
    """(shard, next): the shard of a long key among `shards`, and where its next jump leads, which is beyond them all. With
    one more shard a key whose next jump is that shard moves there, and no other moves. A null key counts as 0.

    b rises with every jump, so `shards` jumps always suffice.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    state = F.struct(F.coalesce(key.cast("long"), F.lit(0)).alias("key"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def jump(s, _):
        nxt = F.struct(_next_key(s["key"]).alias("key"))
        return F.when(s["j"] >= shards, s).otherwise(
            F.transform(
                F.array(nxt),
                lambda n: F.struct(
                    n["key"].alias("key"),
                    s["j"].alias("b"),
                    F.floor(
                        (s["j"] + 1).cast("double")
                        * (F.lit(2147483648.0) / (F.shiftrightunsigned(n["key"], 33) + 1).cast("double"))
                    ).cast("long").alias("j"),
                ),
            )[0]
        )

    end = lambda s: F.struct(s["b"].cast("int").alias("shard"), s["j"].alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, jump, end)


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row by its key alone: key, size, text_crc32, shard, grown_shard and a slot in the shard.

    size is the text's UTF-8 bytes plus 16; a null text counts as empty (size 16, crc 0) and a null key as key 0 in
    placing. Rows that repeat keep a slot each. Slots run from 0 without gaps within a shard; they are handed out by
    buckets of key and text, in order of bucket, key, size and crc, so that no shard is gathered in one task; only rows that
    repeat whole share a bucket. Other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body).cast("long") + F.lit(16)).alias("size"),
        F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
    )
    rows = rows.withColumn("__at", jumps(F.col(key), shards))
    grown = F.when(F.col("__at.next") == shards, shards).otherwise(F.col("__at.shard"))
    rows = rows.withColumns({"shard": F.col("__at.shard"), "grown_shard": grown}).drop("__at")
    bucket = F.pmod(F.coalesce(F.col(key).cast("long"), F.lit(0)), F.lit(BUCKETS)) + F.col("text_crc32") % BUCKETS
    return dense_rank_offsets(rows, "shard", bucket, [key, "size", "text_crc32"], "slot", BUCKETS)
