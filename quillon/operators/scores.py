"""Evidence scores as Column expressions: causality, severity, threads, triangulation, benefit-risk, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed cue weights of the causality score.
CUES = {"temporal": 0.35, "dechallenge": 0.25, "rechallenge": 0.30, "confounder": -0.20, "known": 0.20, "prior": 0.15}


def causality_score(cues: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, there in cues.items():
        total = total + F.when(there, CUES[name]).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 2)


def causality_category(cues: dict[str, Column]) -> Column:
    t, d, r, c, k, p = (cues[n] for n in CUES)
    return F.when(t & d & r, "Certain").when((t & d & ~c) | (k & d), "Probable").when(t | k | p, "Possible").when(c, "Unlikely").otherwise("Unassessable")


def severity(critical: Column, category: Column) -> Column:
    sure = category.isin("Certain", "Probable")
    return F.when(critical & sure, "Critical").when(critical, "High").when(sure, "Medium").otherwise("Low")


def thread_confidence(corroborating: Column, contradicting: Column, ae: Column, n: Column) -> Column:
    """Confidence of a thread without post weights."""
    raw = (corroborating - 0.6 * contradicting) / n
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 + 0.55 * raw + 0.1 * ae / n)), 3)


def thread_rating(confidence: Column, corroborating: Column, contradicting: Column, ae: Column) -> Column:
    red = (confidence >= 0.72) & (corroborating >= 2) & (contradicting <= F.floor(corroborating / 2))
    return F.when(red, "Red").when((confidence >= 0.45) | ((ae >= 2) & (corroborating >= 1)), "Amber").otherwise("Green")


def triangulation(strength: Column, prr: Column, chi2: Column, n: Column, known: Column, reports: Column, persons: Column, digits: int = 6) -> tuple[Column, Column]:
    """Score and tier from social, regulatory and real-world pillars."""
    social_ok = (strength == "STRONG") | ((prr >= 2) & (chi2 >= 4) & (n >= 3))
    best = 0.45 + 0.15 * F.least(prr / 5, F.lit(1.0)) + 0.2 * F.when(strength == "STRONG", 1.0).otherwise(0.5)
    social = F.when(social_ok, F.least(F.lit(1.0), best)).when((prr >= 1.5) & (n >= 2), 0.35).when(n >= 1, 0.15).otherwise(0.0)
    regulatory_ok = known | (reports >= 3)
    regulatory = F.when(known & (reports >= 10), 0.95).when(regulatory_ok, 0.75).when(reports >= 1, 0.4).otherwise(0.0)
    world_ok = persons >= 3
    world = F.when(world_ok, F.least(F.lit(1.0), persons / 10)).otherwise(0.0)
    every = social_ok & regulatory_ok & world_ok
    score = F.least(F.lit(1.0), 0.35 * social + 0.40 * regulatory + 0.25 * world + F.when(every, 0.12).otherwise(0.0))
    tier = F.when(every, "CRITICAL_URGENT").when(social_ok & regulatory_ok, "HIGH_EARLY_WARNING").when(social_ok & ~world_ok, "EMERGENT_CHATTER").when(regulatory_ok & ~social_ok, "REGULATORY_ONLY").otherwise("INSUFFICIENT")
    return F.round(score, digits), tier


def rem(a: Column, n: Column, cohort_a: Column, cohort_n: Column) -> Column:
    """Risk elevation of a stratum over its cohort, with half a case added."""
    return F.round(((a + 0.5) / (n + 1)) / ((cohort_a + 0.5) / (cohort_n + 1)), 3)


def label_change(sdr: Column, novel: Column, strengthening: Column, n: Column, eb05: Column) -> Column:
    total = sum((F.when(c, w).otherwise(0.0) for c, w in ((sdr, 0.25), (novel, 0.30), (strengthening, 0.25), (n >= 5, 0.10), (eb05 >= 2, 0.10))), F.lit(0.0))
    return F.round(F.least(F.lit(0.95), total), 2)


def lot_flag(top: Column, total: Column) -> tuple[Column, Column]:
    coefficient = F.round(top / total, 3)
    return coefficient, (coefficient >= 0.8) & (top >= 3) & (total >= 3)
