"""Addresses that must not be fetched."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Address blocks of special use, by name, in the order of their addresses.
BLOCKS = {
    "this": "0.0.0.0/8", "private10": "10.0.0.0/8", "carrier": "100.64.0.0/10", "loopback": "127.0.0.0/8", "linklocal": "169.254.0.0/16",
    "private172": "172.16.0.0/12", "protocol": "192.0.0.0/24", "test1": "192.0.2.0/24", "relay": "192.88.99.0/24", "private192": "192.168.0.0/16",
    "benchmark": "198.18.0.0/15", "test2": "198.51.100.0/24", "test3": "203.0.113.0/24", "multicast": "224.0.0.0/4", "reserved": "240.0.0.0/4",
}
BLOCKS6 = {"unspecified": "::/128", "loopback6": "::1/128", "unique": "fc00::/7", "linklocal6": "fe80::/10", "multicast6": "ff00::/8"}


def ip_number(text: Column) -> Column:
    """An IPv4 address as a number; null if it is none, as with a part above 255."""
    p = F.split(text, r"\.")
    part = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.when(text.rlike(rf"^({part}\.){{3}}{part}$"), sum((p[i].try_cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0)))


def ip6_hex(text: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits; null if it is none. The last 32 bits may be written as IPv4."""
    low = F.lower(text)
    v4 = ip_number(F.regexp_extract(low, r"(\d+\.\d+\.\d+\.\d+)$", 1))
    low = F.when(v4.isNotNull(), F.concat(F.regexp_replace(low, r"\d+\.\d+\.\d+\.\d+$", ""), F.hex(F.floor(v4 / 65536)), F.lit(":"), F.hex(v4 % 65536))).otherwise(low)
    low = F.lower(low)
    sides = F.split(low, "::", -1)
    words = lambda c: F.filter(F.split(c, ":"), lambda w: w != "")
    left, right = words(sides[0]), F.coalesce(words(F.try_element_at(sides, F.lit(2))), F.array().cast("array<string>"))
    gap = 8 - F.size(left) - F.size(right)
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    shape = low.rlike(r"^[0-9a-f:]*$") & ~low.rlike(r":::|^:[^:]|[^:]:$") & low.contains(":")
    ok = shape & (F.size(full) == 8) & F.forall(full, lambda w: w.rlike(r"^[0-9a-f]{1,4}$"))
    ok = ok & F.when(F.size(sides) == 1, gap == 0).otherwise((F.size(sides) == 2) & (gap >= 1))
    return F.when(ok, F.array_join(F.transform(full, lambda w: F.lpad(w, 4, "0")), ""))


def refused(rows: DataFrame, ip: str) -> DataFrame:
    """rows with refused: the block that holds the IPv4 address, given as a number, or null. Each block is a constant pair
    of bounds, so this is a projection and no join."""
    return rows.withColumn("refused", _within(F.col(ip), BLOCKS, lambda n: F.lit(int(n))))


def refused_text(rows: DataFrame, ip: str) -> DataFrame:
    """rows with refused: the block that holds the address, IPv4 or IPv6 as text; `invalid` if it is no address. An IPv6
    address that stands for an IPv4 one is judged as that."""
    v6 = ip6_hex(F.col(ip))
    mapped = F.when(F.substring(v6, 1, 24) == "0" * 20 + "ffff", F.conv(F.substring(v6, 25, 8), 16, 10).cast("long"))
    v4 = F.coalesce(ip_number(F.col(ip)), mapped)
    known = F.coalesce(_within(v4, BLOCKS, lambda n: F.lit(int(n))), _within(v6, BLOCKS6, lambda n: F.lit(f"{int(n):032x}")))
    return rows.withColumn("refused", F.when(v4.isNull() & v6.isNull(), "invalid").otherwise(known))


def _within(value: Column, blocks: dict[str, str], bound) -> Column:
    out = F.lit(None).cast("string")
    for name, block in blocks.items():
        net = ipaddress.ip_network(block)
        out = F.when(value.between(bound(net.network_address), bound(net.broadcast_address)), name).otherwise(out)
    return out


def retry_after(header: Column, now: Column, most: int = 3600) -> Column:
    """Seconds of a Retry-After header, a number or an HTTP date, from 0 to `most`; null if it is neither."""
    seconds = header.try_cast("bigint")
    date = F.try_to_timestamp(F.regexp_replace(header, r"^\w{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    wait = F.coalesce(seconds, F.unix_seconds(date) - F.unix_seconds(now))
    return F.when(wait.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(most), wait)))
