"""Disproportionality statistics as Column functions. Cells a, b, c, d of a 2x2 table are columns of those names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normal quantile of two-sided 95 %, and the continuity correction of empty cells.
Z95 = 1.96
HALDANE = 0.5


def expected() -> Column:
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    return (F.col("a") + F.col("b")) * (F.col("a") + F.col("c")) / n


def _smoothed() -> list[Column]:
    return [F.col(x) + HALDANE for x in "abcd"]


def interval(ratio: Column, se: Column, name: str) -> list[Column]:
    """name, name_low and name_high of a ratio with the standard error of its logarithm."""
    low, high = (F.exp(F.log(ratio) + s * Z95 * se) for s in (-1, 1))
    return [F.round(ratio, 3).alias(name), F.round(low, 3).alias(f"{name}_low"), F.round(high, 3).alias(f"{name}_high")]


def prr() -> list[Column]:
    a, b, c, d = _smoothed()
    variance = 1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)
    return interval((a / (a + b)) / (c / (c + d)), F.sqrt(F.greatest(F.lit(1e-9), variance)), "prr")


def ror() -> list[Column]:
    a, b, c, d = _smoothed()
    return interval(a * d / (b * c), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d), "ror")


def yates_chi2() -> Column:
    """Yates' chi-squared, not clamped where observed and expected differ by less than a half; 0 without a margin."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    value = n * F.pow(F.abs(a * d - b * c) - n / 2, F.lit(2)) / margins
    return F.round(F.when(margins == 0, 0.0).otherwise(value), 3)


def information_component() -> list[Column]:
    a, e = F.col("a") + 0.5, expected() + 0.5
    ic = F.log2(a / e)
    sd = F.sqrt((1 / a + 1 / e) / F.pow(F.log(F.lit(2.0)), F.lit(2)))
    return [F.round(ic, 3).alias("ic"), F.round(ic - Z95 * sd, 3).alias("ic025")]


def strength() -> Column:
    """Tier on the rounded values."""
    strong = (F.col("prr") >= 2) & (F.col("chi_square") >= 4) & (F.col("a") >= 3)
    return F.when(strong, "STRONG").when((F.col("prr") >= 1.5) & (F.col("a") >= 2), "MODERATE").otherwise("WEAK")


def sdr_by_prr() -> Column:
    return (F.col("prr_low") >= 1) & (F.col("chi_square") >= 4) & (F.col("a") >= 3)


def sdr() -> Column:
    """Needs ic025, eb05 and the PRR columns."""
    return (F.col("ic025") > 0) | (F.col("eb05") >= 2) | sdr_by_prr()


def shrinkage(observed: Column, expected_: Column) -> tuple[Column, Column]:
    """Omega and its lower bound."""
    omega = F.log2((observed + 0.5) / (expected_ + 0.5))
    return omega, omega - Z95 * F.sqrt(1 / (observed + 0.5)) / F.log(F.lit(2.0))


def poisson_llr(c: Column, mu: Column) -> Column:
    return F.when((c > mu) & (mu > 0), c * F.log(c / mu) - (c - mu)).otherwise(0.0)


def scan_llr(n: Column, mu: Column, total: Column) -> Column:
    """Kulldorff's Poisson scan statistic of an area."""
    rest = F.when(total > n, (total - n) * F.log((total - n) / (total - mu))).otherwise(0.0)
    return F.when((n > mu) & (mu > 0) & (total > mu), n * F.log(n / mu) + rest).otherwise(0.0)


def e_value(rr: Column) -> Column:
    return F.round(F.when(rr > 1, rr + F.sqrt(rr * (rr - 1))).otherwise(1.0), 2)
