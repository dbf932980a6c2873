"""Golden values of the central operator, edge cases of kernels, and models against plain formulas."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import kernels, special
from quillon.operators import dma, models, trends

REPORTS = {("isotretinoin", "depression"): 18, ("metformin", "nausea"): 6, ("ibuprofen", "headache"): 4, ("isotretinoin", "fatigue"): 3, ("metformin", "fatigue"): 2, ("gabapentin", "dizziness"): 5}
#: a, b, c, d, PRR, chi-squared, IC, IC025, EBGM, EB05, strength, SDR.
GOLDEN = {
    ("isotretinoin", "depression"): (18, 3, 0, 17, 30.273, 24.354, 0.824, -0.27, 1.874, 1.273, "STRONG", True),
    ("metformin", "nausea"): (6, 2, 0, 30, 44.778, 21.376, 1.882, -0.519, 4.380, 2.319, "STRONG", True),
    ("ibuprofen", "headache"): (4, 0, 0, 34, 63.0, 28.124, 2.289, -0.945, 6.339, 2.999, "STRONG", True),
    ("isotretinoin", "fatigue"): (3, 18, 2, 15, 1.145, 0.065, 0.101, -2.075, 1.395, 0.607, "WEAK", False),
    ("metformin", "fatigue"): (2, 6, 3, 27, 2.46, 0.277, 0.687, -2.202, 2.325, 0.900, "MODERATE", False),
    ("gabapentin", "dizziness"): (5, 0, 0, 33, 62.333, 29.752, 2.248, -0.643, 5.882, 2.964, "STRONG", True),
}


@pytest.fixture(scope="module")
def reports(spark):
    return spark.createDataFrame([(d, e) for (d, e), n in REPORTS.items() for _ in range(n)], "drug string, event string")


def test_golden_signals(reports):
    got = {(r.drug, r.event): r for r in dma.bayes(dma.disproportionality(reports)).collect()}
    assert set(got) == set(GOLDEN)
    for k, want in GOLDEN.items():
        r = got[k]
        found = (r.a, r.b, r.c, r.d, r.prr, r.chi_square, r.ic, r.ic025, r.ebgm, r.eb05, r.strength, r.sdr)
        assert all(x == y if isinstance(y, (str, bool, int)) else math.isclose(x, y, abs_tol=2e-3) for x, y in zip(found, want)), (k, found)


def test_empty_and_small_inputs(spark, reports):
    assert dma.disproportionality(reports.limit(0)).count() == 0
    prior = dma.gamma_prior(dma.cells(dma.pair_counts(reports.where("drug = 'metformin'")))).first()
    assert (prior.alpha, prior.beta) == (1.0, 1.0)
    one = spark.createDataFrame([("x", 3)], "k string, n int").withColumn("day", F.lit("2024-01-01").cast("date"))
    r = trends.trend(one, "k").first()
    assert r.trend_score == 0 and not r.spike and r.ewma == 3


def test_ewma(spark):
    rows = spark.createDataFrame([("x", i, n) for i, n in enumerate([1, 2, 5])], "k string, i int, n int")
    rows = rows.select("k", F.date_add(F.lit("2024-01-01").cast("date"), "i").alias("day"), "n")
    assert trends.trend(rows, "k").first().ewma == 2.84


def test_special_functions():
    x = np.array([0.5, 1.0, 3.7, 20.0])
    h = 1e-5
    slope = [(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x]
    assert np.allclose(special.digamma(x), slope, atol=1e-6)
    for a in (0.3, 1.0, 4.5, 60.0):
        assert math.isclose(special.gamma_p(a, special.gamma_quantile(0.05, a)), 0.05, abs_tol=1e-9)
    assert math.isclose(special.gamma_p(1.0, 2.0), 1 - math.exp(-2.0), abs_tol=1e-12)


def test_critical_values(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 15, 5000)], "n int").select(trends.critical_value(F.col("n")).alias("cv")).collect()
    assert [round(r.cv, 3) for r in rows] == [0.0, 1.03, 2.54, 4.763]


def test_kernels_at_the_edges(spark):
    r = spark.createDataFrame([(0, 0, 0, 0)], "a int, b int, c int, d int").select(kernels.yates_chi2().alias("chi"), kernels.e_value(F.lit(0.5)).alias("e"), kernels.poisson_llr(F.lit(2), F.lit(3.0)).alias("llr")).first()
    assert (r.chi, r.e, r.llr) == (0.0, 1.0, 0.0)


def test_adjusted_odds_and_cox(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(4000):
        z = int(rng.random() < 0.5)
        e = int(rng.random() < (0.7 if z else 0.3))
        y = int(rng.random() < 1 / (1 + math.exp(1.5 - 0.7 * e - 1.5 * z)))
        t = int(min(99, rng.exponential(30 / (2.0 if e else 1.0)))) + 1
        rows.append(("k", e, y, z, t, int(t < 99)))
    df = spark.createDataFrame(rows, "key string, e int, y int, z int, t int, d int")
    r = models.adjusted_odds(df, "key", "e", "y", ["z"]).first()
    assert abs(math.log(r.adjusted_or) - 0.7) < 0.25 < math.log(r.crude_or) - 0.7 + 0.1
    h = models.cox(df, "key", "t", "d", "e").first()
    assert 1.7 < h.hazard_ratio < 2.3 and h.p_value < 0.001
