"""The central operator: 2x2 cells of product-event pairs and the statistics on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import kernels
from quillon.functions.special import ebgm_eb05
from quillon.sources.tables import materialised


def pair_counts(rows: DataFrame, drug: str = "drug", event: str = "event") -> DataFrame:
    """(drug, event, a): a row of the input per mention; partial aggregation before the shuffle."""
    return rows.groupBy(F.col(drug).alias("drug"), F.col(event).alias("event")).agg(F.count("*").alias("a"))


def cells(pairs: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Add b, c and d from the margins of the pair table (of each group, if `within` names columns).

    The pair table is small against the mentions: margins are summed over it, not over the input.
    """
    keys = within or []
    margin = lambda *by: pairs.groupBy(*keys, *by).agg(F.sum("a").alias("n"))
    drug, event = margin("drug").withColumnRenamed("n", "by_drug"), margin("event").withColumnRenamed("n", "by_event")
    total = margin().withColumnRenamed("n", "total")
    rows = pairs.join(drug, [*keys, "drug"]).join(event, [*keys, "event"])
    rows = rows.join(total, keys) if keys else rows.crossJoin(F.broadcast(total))  # one row
    rows = rows.withColumns({"b": F.col("by_drug") - F.col("a"), "c": F.col("by_event") - F.col("a")})
    return rows.withColumn("d", F.col("total") - F.col("a") - F.col("b") - F.col("c")).drop("by_drug", "by_event", "total")


def measures(rows: DataFrame) -> DataFrame:
    """PRR, ROR, chi-squared, expected, information component and strength of rows with cells."""
    keep = [F.col(c) for c in rows.columns]
    out = rows.select(*keep, F.round(kernels.expected(), 3).alias("expected"), *kernels.prr(), *kernels.ror(), kernels.yates_chi2().alias("chi_square"), *kernels.information_component())
    return out.withColumn("strength", kernels.strength())


def gamma_prior(rows: DataFrame) -> DataFrame:
    """alpha and beta by moments of a / E over all rows: (1, 1) below 3 rows, (2, 2) without variance."""
    ratio = F.col("a") / kernels.expected()
    m = rows.agg(F.count("*").alias("n"), F.avg(ratio).alias("m"), F.var_pop(ratio).alias("v"))

    def bounded(x):
        return F.greatest(F.lit(0.2), F.least(F.lit(50.0), x))

    def either(x):
        return F.when(F.col("n") < 3, 1.0).when(F.col("v") <= 1e-9, 2.0).otherwise(bounded(x))

    return m.select("n", either(F.col("m") ** 2 / F.col("v")).alias("alpha"), either(F.col("m") / F.col("v")).alias("beta"))


def bayes(rows: DataFrame) -> DataFrame:
    """EBGM, EB05 and the full SDR flag; special functions run once per different (a, E)."""
    rows = rows.withColumn("e", kernels.expected())
    points = rows.select("a", "e").distinct().crossJoin(F.broadcast(gamma_prior(rows)))
    points = points.withColumn("x", ebgm_eb05(F.col("a").cast("double"), "e", "alpha", "beta")).select("a", "e", "x.ebgm", "x.eb05")
    return rows.join(points, ["a", "e"]).drop("e").withColumn("sdr", kernels.sdr())


def disproportionality(rows: DataFrame, drug: str = "drug", event: str = "event") -> DataFrame:
    return measures(cells(materialised(pair_counts(rows, drug, event), "pairs")))  # else each margin counts the mentions again


def without_posts_of(rows: DataFrame, drugs: DataFrame) -> DataFrame:
    """Drop whole posts that mention any of the drugs (case-level unmasking)."""
    hit = rows.join(F.broadcast(drugs.select("drug")) if drugs.isLocal() else drugs.select("drug"), "drug", "left_semi").select("post").distinct()
    return rows.join(hit, "post", "left_anti")


def ranked(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
