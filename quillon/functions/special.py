"""Special functions that Spark lacks, as pandas UDFs over aggregated tables: EBGM, EB05 and the normal tail."""

from __future__ import annotations

import difflib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 8, then the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (small := x < 8).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    i = 1 / x**2
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def gamma_quantile(p: float, a: float) -> float:
    """x with P(a, x) = p, by bisection from the Wilson-Hilferty neighbourhood."""
    lo, hi = 0.0, max(1.0, a * 4 + 20)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(a, mid) < p else (lo, mid)
        if hi - lo < 1e-12 * max(1.0, hi):
            break
    return (lo + hi) / 2


def ebgm(a: np.ndarray, e: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.exp(digamma(alpha + a) - np.log(beta + e))


@F.pandas_udf(StructType([StructField("ebgm", DoubleType()), StructField("eb05", DoubleType())]))
def ebgm_eb05(a: pd.Series, e: pd.Series, alpha: pd.Series, beta: pd.Series) -> pd.DataFrame:
    low = [gamma_quantile(0.05, x + y) / (b + z) for x, y, b, z in zip(alpha, a, beta, e)]
    return pd.DataFrame({"ebgm": np.round(ebgm(a.values, e.values, alpha.values, beta.values), 3), "eb05": np.round(low, 3)})


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)) if v == v else None)


@F.pandas_udf(DoubleType())
def half_even_2(x: pd.Series) -> pd.Series:
    """Rounded to two digits, the exact binary value deciding and ties going to the even digit."""
    return x.map(lambda v: round(v, 2) if v == v else None)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the length of the matching blocks of two texts over their joint length."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])
