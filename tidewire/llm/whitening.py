"""Embedding whitening with an exact scatter in residue numbers.

Entries become whole numbers x. The scatter of y = n x - S, with n vectors and sums S, is n^2 times the centred one, and is
whole. Each partition multiplies its residues of y by several primes in double precision, where no sum reaches 2^53, so
the products are exact; Spark adds up the residues, and Chinese remaindering on the driver gives the scatter itself, of
d x d whole numbers whatever the rows. Its quotient by n^3, rounded once, goes to a double eigendecomposition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import cut

SCALE, SHIFT, LIMIT = 1024, 100_000, 1 << 62
_TOP = 1 << 21  # primes are below: 2^11 products of residues from -p/2 to p/2 stay below 2^51
_ROWS = 1 << 11


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    axes: np.ndarray  # dimensions x components, unit columns
    values: np.ndarray  # eigenvalues of the components, falling
    trace: float
    reach: int  # no |n x - S| is larger


def primes(product: int) -> list[int]:
    """The largest primes below 2^21, as many as their product needs to pass `product`."""
    out, p = [], _TOP - 1
    while prod(out) <= product:
        if all(p % k for k in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
        p -= 2
    return out


def remaindered(residues: list[np.ndarray], by: list[int]) -> np.ndarray:
    """The whole numbers nearest to 0 with these residues, as Python's."""
    whole = prod(by)
    total = sum(r.astype(object) % p * (whole // p * pow(whole // p, -1, p)) for r, p in zip(residues, by)) % whole
    return np.where(total > whole // 2, total - whole, total)


def whole_numbers(vectors: pd.Series) -> np.ndarray:
    """floor(1024 c) + 100,000; products beyond 2^62 are held there."""
    c = np.stack([np.asarray(v, np.float64) for v in vectors])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _fit_for_use(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """key and vector of rows whose vector is finite throughout and has entries, as many as most such vectors have. Of
    equally common sizes the larger is taken."""
    rows = table.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(_fit_for_use(F.col("v")) & (F.size("v") > 0))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (size[0]["d"] if size else 0))


def fit(rows: DataFrame, components: int = 8) -> Whitening | None:
    """Learn from usable() rows; None if there are none or all are alike. Components whose eigenvalue is rounding alone
    (below d 2^-52 of the trace) are left out, since nothing can whiten them."""

    def extent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, low, high = 0, 0, None, None
        for b in batches:
            for i in range(0, len(b), _ROWS):
                x = whole_numbers(b["v"].iloc[i : i + _ROWS])
                n, sums = n + len(x), sums + x.astype(object).sum(0)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield pd.DataFrame({"at": range(len(low)), "n": n, "s": [Decimal(v) for v in sums], "low": low, "high": high})

    got = rows.select("v").mapInPandas(extent, "at int, n long, s decimal(38,0), low long, high long")
    got = got.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()
    if not got:
        return None
    n, sums = int(got[0]["n"]), [int(r["s"]) for r in got]
    reach = max(max(abs(n * int(r[e]) - s) for e in ("low", "high")) for r, s in zip(got, sums))
    if not reach:
        return None
    by = primes(2 * n * reach * reach)
    d = len(sums)
    upper = np.triu_indices(d)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(by), d, d), np.int64)
        for b in batches:
            for i in range(0, len(b), _ROWS):
                x = whole_numbers(b["v"].iloc[i : i + _ROWS])
                for k, p in enumerate(by):
                    y = ((x % p) * (n % p) - np.array([s % p for s in sums], np.int64)) % p
                    y = np.where(y > p // 2, y - p, y).astype(np.float64)
                    total[k] = (total[k] + (y.T @ y).astype(np.int64)) % p
        for k in range(len(by)):
            yield pd.DataFrame({"prime": k, "i": upper[0], "j": upper[1], "r": total[k][upper]})

    sent = rows.select("v").mapInPandas(products, "prime int, i int, j int, r long").groupBy("prime", "i", "j").agg(F.sum("r").alias("r")).toPandas()
    residues = np.zeros((len(by), d, d), np.int64)
    residues[sent["prime"], sent["i"], sent["j"]] = residues[sent["prime"], sent["j"], sent["i"]] = sent["r"]
    scatter = remaindered(list(residues), by)
    variance = np.array([[q / n**3 for q in row] for row in scatter.tolist()])
    values, axes = np.linalg.eigh(variance)
    trace = sum(scatter[i, i] for i in range(d)) / n**3
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > trace * d * 2.0**-52]
    return Whitening(n, sums, axes[:, order], values[order], trace, reach) if len(order) else None


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """key, deviation (the exact sum of (n x - S)^2, a decimal), whitened (an array by component) of usable() rows."""
    n, d = model.n, len(model.sums)
    narrow = d * model.reach * model.reach < 1 << 63 and max(map(abs, model.sums)) < 1 << 62
    base, rest = np.array([s // n for s in model.sums], object), np.array([s % n for s in model.sums], object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), _ROWS):
                part = b.iloc[i : i + _ROWS]
                x = whole_numbers(part["v"])
                if narrow:  # n (x - base) - rest is no longer than reach
                    y = (x - base.astype(np.int64)) * n - rest.astype(np.int64)
                    deviation = np.einsum("ij,ij->i", y, y)
                else:
                    y = x.astype(object) * n - np.array(model.sums, object)
                    deviation = (y * y).sum(1)
                w = (y.astype(np.float64) / n) @ model.axes / np.sqrt(model.values)
                yield pd.DataFrame({"key": part["key"], "deviation": [Decimal(int(v)) for v in deviation], "whitened": list(w)})

    return rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of the array column whitened, less the identity. Products are of
    values less their means."""
    w = lambda i: F.col("whitened")[i]
    means = whitened.agg(F.count(F.lit(1)).alias("n"), *[F.avg(w(i)).alias(f"m{i}") for i in range(components)]).head()
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    got = whitened.agg(*[F.sum((w(i) - means[f"m{i}"]) * (w(j) - means[f"m{j}"])).alias(f"{i}_{j}") for i, j in pairs]).head()
    return max(abs(got[f"{i}_{j}"] / means["n"] - (i == j)) for i, j in pairs)


def whitening(table: DataFrame, key: str, vector: str, components: int = 8) -> DataFrame:
    """key, component (from 1), n, deviation (decimal), whitened, explained, identity_error of each usable row.

    Rows with a null vector, or a null or non-finite entry, take no part; nor do vectors of another size than most, or
    without entries. A null key stays. Repeated rows count each. Vectors that are all alike, a single one, or an empty
    table have no component and give no row. Other columns of the table are not read, whatever their names.
    """
    rows = usable(table, key, vector)
    model = fit(rows, components)
    if model is None:
        none = rows.select("key", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"), F.lit(0.0).alias("whitened"))
        return none.select("*", F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error")).where(F.lit(False)).withColumnRenamed("key", key)
    got = cut(whiten(rows, model))
    error = identity_error(got, len(model.values))
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    got = got.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return got.select(
        F.col("key").alias(key),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("at")].alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
