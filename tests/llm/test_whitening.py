from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from tidewire.llm.whitening import primes, remaindered, whitening

SCHEMA = "vec_id long, embedding array<float>, key string, whitened double"


def rows_of(vectors):
    return [(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1.0) for i, v in enumerate(vectors)]


def plain(vectors):
    """n, deviations, mean, covariance in fractions."""
    x = [[floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(v[j] for v in x) for j in range(d)]
    y = [[n * v[j] - sums[j] for j in range(d)] for v in x]
    cov = [[Fraction(sum(v[i] * v[j] for v in y), n**3) for j in range(d)] for i in range(d)]
    return n, [sum(c * c for c in v) for v in y], np.array([[float(Fraction(c, n)) for c in v] for v in y]), np.array(cov, float)


def test_equals_fractions(spark):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) * np.geomspace(1, 1e-3, 12) + 3).astype(np.float32).tolist()
    v += [v[0], v[0], [0.0] * 12]
    odd = [None, [None] * 12, [nan] + [0.0] * 11, [inf] + [0.0] * 11, [-inf] + [0.0] * 11, [1.0, 2.0], []]
    df = spark.createDataFrame(rows_of(v + odd), SCHEMA).repartition(5)
    got = whitening(df, "vec_id", "embedding").collect()
    n, deviations, centred, cov = plain(v)
    assert len(got) == 8 * n and {r.vec_id for r in got} == set(range(n)) and {r.n for r in got} == {n}
    assert all(int(r.deviation) == deviations[r.vec_id] for r in got)
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    want = centred @ axes[:, :8] / np.sqrt(e[:8])
    have = np.zeros((n, 8))
    for r in got:
        have[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(cov), rel=1e-6)
    sign = np.sign((have * want).sum(0))
    assert np.allclose(have * sign, want, rtol=1e-6, atol=1e-6)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6


def test_remaindering_is_exact_for_numbers_of_any_size():
    values = [0, 1, -1, 3**200, -(5**120), 2**63, -(2**63)]
    by = primes(2 * 3**200)
    assert len(set(by)) == len(by) and max(by) < 1 << 21
    got = remaindered([np.array([v % p for v in values]) for p in by], by)
    assert got.tolist() == values


def test_entries_beyond_64_bits_of_products(spark):
    v = [[3.0e12, 1.0], [-2.0e12, 2.0], [1.0e12, -5.0], [0.0, 0.5]]
    got = whitening(spark.createDataFrame(rows_of(v), SCHEMA), "vec_id", "embedding").collect()
    _, deviations, _, _ = plain(v)
    assert all(int(r.deviation) == deviations[r.vec_id] for r in got) and got[0].identity_error < 1e-4


def test_defined_cases(spark):
    of = lambda v: whitening(spark.createDataFrame(rows_of(v), SCHEMA), "vec_id", "embedding")
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for v in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []]):
        assert of(v).columns == names and of(v).count() == 0
    got = of([[1.0, 1.0], [2.0, 2.0], [4.0, 4.0]]).collect()  # one direction only
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)
    assert of([[1.0], [2.0], [1.0, 2.0, 3.0], [2.0, 1.0, 5.0]]).select("vec_id").distinct().count() == 2  # of equally common sizes the larger
    df = spark.createDataFrame([(None, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(str(r.vec_id) for r in whitening(df, "vec_id", "embedding").collect()) == ["1", "1", "None"]
