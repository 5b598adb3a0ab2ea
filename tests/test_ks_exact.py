"""Exact two-sample p-values against counts of whole-number lattice paths."""

from fractions import Fraction
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlake.operators import stats as ST


def counted(edge: int, n_a: int, n_b: int) -> Fraction:
    """Share of the paths that reach |i * n_b - j * n_a| >= edge."""
    ways = {(0, 0): 1}
    for i in range(n_a + 1):
        for j in range(n_b + 1):
            if i or j:
                ways[i, j] = 0 if abs(i * n_b - j * n_a) >= edge else ways.get((i - 1, j), 0) + ways.get((i, j - 1), 0)
    return 1 - Fraction(ways[n_a, n_b], comb(n_a + n_b, n_a))


@pytest.mark.parametrize("n_a,n_b", [(1, 1), (2, 5), (10, 10), (10, 37), (25, 24), (60, 60), (80, 13)])
def test_p_values_equal_path_counts(n_a, n_b):
    for edge in sorted({*range(0, n_a * n_b + 1, max(1, n_a * n_b // 40)), n_a * n_b}):
        want = float(counted(edge, n_a, n_b)) if edge else 1.0
        assert ST.two_sample_tail(edge / (n_a * n_b), n_a, n_b) == pytest.approx(want, rel=1e-9, abs=0)


def test_known_values():
    # all of one sample below all of the other: two of the comb(2n, n) orders
    assert ST.two_sample_tail(1.0, 10, 10) == pytest.approx(2 / 184756, rel=1e-12)
    assert ST.two_sample_tail(1.0, 200, 200) == pytest.approx(2 / comb(400, 200), rel=1e-9)
    n = 3000  # the limit is close for large samples
    lam = 0.03 * np.sqrt(n / 2)
    limit = 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * lam * lam) for k in range(1, 100))
    assert ST.two_sample_tail(0.03, n, n) == pytest.approx(limit, rel=0.03)


def test_ks_test_is_exact_up_to_its_size(spark):
    rng = np.random.default_rng(1)
    rows = [("KEPLER", float(v), 1.0) for v in rng.normal(size=30)] + [("TESS", float(v), 1.0) for v in rng.normal(0.8, size=22)]
    df = spark.createDataFrame(rows, "mission string, x double, same double")
    exact = {r.feature: r for r in ST.ks_test(df, ["x", "same"]).collect()}
    edge = round(exact["x"].d_stat * 30 * 22)
    assert exact["x"].p_value == pytest.approx(float(counted(edge, 30, 22)), rel=1e-9)
    assert exact["same"].p_value == 1.0 and not exact["same"].significant
    limit = ST.ks_test(df, ["x"], exact_rows=25)  # one sample is larger
    assert limit.where(F.abs(F.col("p_value") - exact["x"].p_value) < 1e-12).count() == 0
