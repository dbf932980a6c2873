"""Small per-signal models: penalised logistic regression and a one-covariate Cox model, as grouped pandas."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def irls(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Ridge-penalised logistic regression of weighted rows by reweighted least squares; x has its intercept."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(n * p * (1 - p), 1e-9)
        step = np.linalg.solve(x.T @ (x * w[:, None]) + ridge * np.eye(x.shape[1]), x.T @ (n * (y - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return beta


def adjusted_odds(rows: DataFrame, key: str, exposed: str, outcome: str, covariates: list[str]) -> DataFrame:
    """Crude (with halves added) and covariate-adjusted odds ratio by key.

    Rows are first summed to counts of covariate patterns by Spark, so a group in pandas holds patterns, not rows.
    """
    cols = [exposed, outcome, *covariates]
    patterns = rows.groupBy(key, *cols).agg(F.count("*").cast("double").alias("n"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        e, y, n = (g[c].to_numpy(float) for c in (exposed, outcome, "n"))
        a, b, c, d = ((n * (e == i) * (y == j)).sum() + 0.5 for i, j in ((1, 1), (1, 0), (0, 1), (0, 0)))
        x = np.column_stack([np.ones(len(g)), e, *(g[v].to_numpy(float) for v in covariates)])
        beta = irls(x, y, n)
        return pd.DataFrame({key: [g[key].iloc[0]], "n": [int(n.sum())], "crude_or": [round(a * d / (b * c), 3)], "adjusted_or": [round(math.exp(beta[1]), 3)]})

    kind = rows.schema[key].dataType.simpleString()
    return patterns.groupBy(key).applyInPandas(fit, f"`{key}` {kind}, n long, crude_or double, adjusted_or double")


def cox(rows: DataFrame, key: str, time: str, event: str, exposed: str) -> DataFrame:
    """Hazard ratio of a binary exposure by key: Breslow ties, Newton steps clipped at 2, log-rank p-value.

    Spark sums rows to counts by (time, event, exposure); the risk sets follow from those.
    """
    counts = rows.groupBy(key, time).agg(
        F.sum(F.col(exposed)).alias("n1"), F.sum(1 - F.col(exposed)).alias("n0"), F.sum(F.col(event) * F.col(exposed)).alias("d1"), F.sum(F.col(event) * (1 - F.col(exposed))).alias("d0")
    )

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(time)
        n1, n0, d1, d0 = (g[c].to_numpy(float) for c in ("n1", "n0", "d1", "d0"))
        r1, r0 = n1[::-1].cumsum()[::-1], n0[::-1].cumsum()[::-1]
        d, beta = d1 + d0, 0.0
        p = r1 / np.maximum(r1 + r0, 1)
        v = (d * p * (1 - p)).sum()
        z2 = (d1.sum() - (d * p).sum()) ** 2 / v if v > 0 else 0.0
        for _ in range(50):
            q = r1 * math.exp(beta) / np.maximum(r1 * math.exp(beta) + r0, 1e-12)
            info = (d * q * (1 - q)).sum()
            if info < 1e-9:
                break
            step = max(-2.0, min(2.0, (d1.sum() - (d * q).sum()) / info))
            beta += step
            if abs(step) < 1e-9 or abs(beta) > 20:
                break
        return pd.DataFrame({key: [g[key].iloc[0]], "events": [int(d.sum())], "hazard_ratio": [round(math.exp(max(-20, min(20, beta))), 3)], "p_value": [round(math.erfc(math.sqrt(z2 / 2)), 4)]})

    kind = rows.schema[key].dataType.simpleString()
    return counts.groupBy(key).applyInPandas(fit, f"`{key}` {kind}, events long, hazard_ratio double, p_value double")
