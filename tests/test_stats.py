"""Tails of the binomial distribution against exact sums."""

from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from rivulet.functions.stats import binomial_tail, clopper_pearson


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 2, 7, 40, 300) for k in {0, 1, n // 3, n // 2, n - 1, n} for p in (0.01, 0.3, 0.5, 0.77, 0.999)]
    exact = lambda k, n, p: float(sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k, n + 1)))
    rows = spark.createDataFrame(cases, "k long, n long, p double").select("k", "n", "p", binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).collect()
    assert all(r["t"] == pytest.approx(exact(r["k"], r["n"], r["p"]), rel=1e-9, abs=1e-12) for r in rows)


def test_limits_of_many_trials(spark):
    """the sum took as many terms as trials, at each of 120 steps; here that would be 600 million."""
    low, high = clopper_pearson(F.col("k"), F.col("n"))
    n, k = 5_000_000, 1_500_000
    got = spark.createDataFrame([(k, n)], "k long, n long").select(low.alias("l"), high.alias("h")).first()
    half = 1.959963984540054 * (0.3 * 0.7 / n) ** 0.5
    assert got["l"] == pytest.approx(0.3 - half, abs=1e-6) and got["h"] == pytest.approx(0.3 + half, abs=1e-6)
