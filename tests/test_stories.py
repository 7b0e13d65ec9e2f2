"""Operators on stories, publications and selection against plain Python, with nulls, ties, repeats and empty tables."""

import ipaddress
import random

from pyspark.sql import functions as F

from tidewire.functions import fuzzy
from tidewire.operators import publishing as P
from tidewire.operators import selection as S
from tidewire.operators import stories as ST
from tidewire.plans import catalogue
from tidewire.sources import addresses


def test_addresses_of_both_versions(spark):
    rng = random.Random(1)
    texts = ["10.0.0.1", "256.1.1.1", "1.2.3", "::1", "::", "fe80::1", "fc00:1::", "ff02::2", "2001:db8::1", "1::2::3", ":1", "1:", "::ffff:10.0.0.1", "::ffff:a00:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "g::1", "", "::12345", "100.64.3.4", "64:ff9b::1.2.3.4"]
    texts += [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(60)] + [str(ipaddress.ip_address(rng.getrandbits(128) >> rng.choice([0, 3, 64]))) for _ in range(60)]
    got = {r.ip: r.refused for r in addresses.refused_text(spark.createDataFrame([(t,) for t in texts], "ip string"), "ip").collect()}
    for t in texts:
        try:
            ip = ipaddress.ip_address(t)
        except ValueError:
            assert got[t] == "invalid", t
            continue
        if ip.version == 6 and ip.ipv4_mapped:
            ip = ip.ipv4_mapped
        blocks = addresses.BLOCKS if ip.version == 4 else addresses.BLOCKS6
        want = [n for n, b in blocks.items() if ip in ipaddress.ip_network(b)]
        assert got[t] == (want[0] if want else None), t


def test_repetition_equals_brute_force(spark):
    rows = {r.p_partkey: r for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    got = {r.p_partkey: (round(r.closest, 6), r.penalty) for r in catalogue.QUERIES["repetition_penalty"](spark, "/root/testdata/sf0.001").collect()}
    want = {}
    for k, r in rows.items():
        old = sorted((x for x in rows.values() if x.p_brand == r.p_brand and x.p_partkey < k and (k - x.p_partkey) * 20 <= 12 * 3600), key=lambda x: -x.p_partkey)[:30]
        if old:
            best = round(max(fuzzy.token_sort(r.p_name, x.p_name) for x in old) / 100, 4)
            want[k] = (round(best, 6), 0.25 if best >= 0.85 else 0.0)
    assert got == want


def test_recent_of_caps_and_spans(spark):
    rng = random.Random(4)
    rows = [(i, f"c{i % 2}", rng.randrange(40 * 3600)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, channel string, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r.id: r.recent for r in P.recent_of(df, "channel", "at", "id").collect()}
    for i, c, s in rows:
        old = sorted(((t, j) for j, d, t in rows if d == c and t < s), reverse=True)
        near = [t for t, _ in old[:30] if t >= s - 12 * 3600]
        times = {j: t for j, _, t in rows}
        assert sorted((times[j] for j in got[i] if times[j] < s), reverse=True) == near[: len([j for j in got[i] if times[j] < s])]
        assert len(got[i]) <= 30 and abs(len(got[i]) - len(near)) <= sum(t == s and d == c for _, d, t in rows)
    assert P.recent_of(df.limit(0), "channel", "at", "id").count() == 0


def test_shared_addresses_equal_brute_force(spark):
    rng = random.Random(2)
    pick = lambda n: rng.sample([f"u{i}" for i in range(12)], rng.randint(0, n))
    items = [(i, rng.randrange(6), pick(2), pick(2)) for i in range(40)] + [(50, None, None, ["u1"]), (51, 1, [], None)]
    stories = [(s, pick(3) or None, pick(3)) for s in range(6)]
    i = spark.createDataFrame(items, "item long, own long, urls array<string>, domains array<string>")
    s = spark.createDataFrame(stories, "story long, urls array<string>, domains array<string>")
    got = {(r.item, r.story) for r in ST.shared_address_candidates(i, s, "item", "story", "own").collect()}
    want = {
        (k, t) for k, own, u, d in items for t, v, e in stories
        if own != t and (set(u or []) & set(v or []) or (u and set(d or []) & set(e or [])))
    }
    assert got == want


def test_selection_defined_cases(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    rows = [(1, "active", "2024-01-09 00:00:00"), (2, "merged", "2024-01-09 00:00:00"), (3, None, "2024-01-08 00:00:00"), (4, "active", None), (5, "active", "2024-01-07 23:59:59")]
    df = spark.createDataFrame(rows, "id int, status string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert {r.id for r in df.where(S.eligible(F.col("status"), F.col("at"), now)).collect()} == {1, 3}
    assert {r.id for r in df.where(S.source_due(F.lit(True), F.lit(None).cast("timestamp"), F.col("at"), F.lit(2 * 86400), now)).collect()} == {3, 4, 5}
    bad = spark.range(1).select(S.breakdown_faults(F.create_map(F.lit("momentum"), F.create_map(F.lit("a"), F.lit(float("nan")), F.lit("b"), F.lit(None).cast("double")))).alias("n")).head().n
    assert bad == 3  # two groups missing, one number that is none
    assert [r.id for r in S.search(df, "MERG", ["status"], id=[1, 2]).collect()] == [2]


def test_reassign_keeps_history(spark):
    m = spark.createDataFrame([(1, 10, True), (1, 9, False), (2, 10, True), (3, 11, True)], "item int, story int, is_current boolean")
    moves = spark.createDataFrame([(1, 11), (3, 11), (7, 1)], "item int, target int")
    got = sorted((r.item, r.story, r.is_current) for r in ST.reassign(m, moves, "item", "story", "is_current").collect())
    assert got == [(1, 9, False), (1, 10, False), (1, 11, True), (2, 10, True), (3, 11, True)]
