"""Time-series operators: daily spines, smoothing, spikes, sequential tests, control charts, divergence, casefiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import kernels


def daily(rows: DataFrame, key: str, day: str) -> DataFrame:
    """(key, day, n) for every day from a key's first to its last, zeros included; only daily sums are expanded."""
    counts = rows.groupBy(key, F.col(day).alias("day")).agg(F.count("*").alias("n"))
    span = counts.groupBy(key).agg(F.explode(F.sequence(F.min("day"), F.max("day"), F.expr("interval 1 day"))).alias("day"))
    return span.join(counts, [key, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def trend(series: DataFrame, key: str, alpha: float = 0.4) -> DataFrame:
    """Relative slope, EWMA and spike of the last day against the history, by key.

    The smoothing is a fold over a key's ordered daily sums: one number a day, bounded by the observed span.
    """
    w = Window.partitionBy(key)
    rows = series.withColumns({"i": F.row_number().over(w.orderBy("day")) - 1, "days": F.count("*").over(w)})
    past = F.when(F.col("i") < F.col("days") - 1, F.col("n"))
    by = rows.groupBy(key).agg(
        F.count("*").alias("days"), F.regr_slope("n", "i").alias("slope"), F.avg("n").alias("mean"), F.avg(past).alias("m"), F.stddev_pop(past).alias("s"),
        F.max_by("n", "day").alias("last"), F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: x["n"].cast("double")).alias("values"),
    )

    def smooth(values):
        return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), values[0], lambda s, x: alpha * x + (1 - alpha) * s)

    expected = smooth(F.slice("values", 1, F.greatest(F.size("values") - 1, F.lit(1))))
    z = (F.col("last") - F.col("m")) / F.greatest(F.col("s"), F.sqrt("m"), F.lit(1.0))
    rows = by.select(
        key, "days", F.round(F.coalesce(F.col("slope") / F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean")), F.lit(0.0)), 3).alias("trend_score"),
        F.round(smooth(F.col("values")), 3).alias("ewma"), F.round(expected, 3).alias("expected"), "last", F.round(z, 3).alias("z"),
    )
    spike = (F.col("days") >= 4) & (F.col("z") >= 2) & (F.col("last") >= F.greatest(F.lit(3.0), F.col("expected") + 2))
    return rows.withColumn("spike", spike)


#: Critical values of the sequential Poisson test by cumulated count, at alpha 0.05 and 0.01.
CRITICAL = [
    (1, 0.0), (2, 1.03), (3, 1.38), (4, 1.63), (5, 1.84), (6, 1.99), (8, 2.17), (10, 2.30), (15, 2.54), (20, 2.70), (30, 2.93), (50, 3.17), (75, 3.35), (100, 3.46), (150, 3.62), (200, 3.74), (300, 3.89),
    (500, 4.06), (750, 4.19), (1000, 4.28),
]
CRITICAL_01 = [(1, 0.0), (2, 2.56), (3, 3.32), (5, 4.00), (10, 4.79), (20, 5.57), (50, 6.30), (100, 6.89), (200, 7.47), (500, 8.07), (1000, 8.45)]
#: What the boundary gains beyond the last value, times the logarithm of the ratio.
TAIL = 0.3


def critical_values(alpha: float) -> list[tuple[int, float]]:
    return CRITICAL if alpha >= 0.05 else CRITICAL_01


def critical_value(n, alpha: float = 0.05) -> F.Column:
    """Piecewise linear between the fixed values, the first one below, a logarithmic tail beyond the last."""
    values = critical_values(alpha)
    last, top = values[-1]
    out = top + TAIL * F.log(n / last)
    for (x0, y0), (x1, y1) in reversed(list(zip(values, values[1:]))):
        out = F.when(n <= x1, y0 + (y1 - y0) * (n - x0) / (x1 - x0)).otherwise(out)
    return F.when(n <= values[0][0], values[0][1]).otherwise(out)


def sequential_test(series: DataFrame, key: str, expected_total: float | None = None) -> DataFrame:
    """Poisson MaxSPRT over cumulative daily counts: maximum of the statistic, first crossing."""
    w = Window.partitionBy(key)
    looks = series.withColumns({
        "c": F.sum("n").over(w.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), "look": F.row_number().over(w.orderBy("day")),
        "looks": F.count("*").over(w), "total": F.sum("n").over(w),
    })
    expected = F.lit(expected_total) if expected_total is not None else F.col("total") * 0.8
    llr = kernels.poisson_llr(F.col("c"), expected / F.col("looks") * F.col("look"))
    cv = critical_value(F.col("total"))
    rows = looks.withColumns({"llr": llr, "cv": cv})
    return rows.groupBy(key).agg(
        F.max("total").alias("total"), F.round(F.max("llr"), 3).alias("max_llr"), F.round(F.max("cv"), 3).alias("critical"),
        F.min(F.when((F.col("llr") >= F.col("cv")) & (F.col("cv") > 0), F.col("look"))).alias("first_crossing"),
    )


def control_chart(rows: DataFrame, day: str) -> DataFrame:
    """Shewhart limits over the days present: mean and three population sigmas, floored at 0."""
    counts = rows.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"))
    limits = counts.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))
    both = counts.crossJoin(F.broadcast(limits))
    upper, lower = F.col("mean") + 3 * F.col("sd"), F.greatest(F.lit(0.0), F.col("mean") - 3 * F.col("sd"))
    return both.select("day", "n", F.round(upper, 3).alias("ucl"), F.round(lower, 3).alias("lcl"), ((F.col("n") > upper) | (F.col("n") < lower)).alias("breach"))


def divergence(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two weekly series aligned by a full join with zeros; z of the first's last week, slope, flatness of the second."""
    both = first.select(key, F.col("n").alias("x")).join(second.select(key, F.col("n").alias("y")), key, "full").fillna(0, ["x", "y"])
    w = Window.orderBy(key)  # one row a week
    rows = both.withColumns({"i": F.row_number().over(w) - 1, "weeks": F.count("*").over(Window.partitionBy())})
    past = F.col("i") < F.col("weeks") - 1
    by = rows.agg(
        F.count("*").alias("weeks"), F.max_by("x", key).alias("last"), F.avg(F.when(past, F.col("x"))).alias("m"), F.stddev_pop(F.when(past, F.col("x"))).alias("s"),
        F.regr_slope("x", "i").alias("slope"), F.avg(F.when(F.col("i") >= F.col("weeks") - 4, F.col("y"))).alias("tail"), F.avg("y").alias("mean_y"),
    )
    z = F.when(F.col("s") > 0, (F.col("last") - F.col("m")) / F.col("s")).otherwise(0.0)
    return by.select("weeks", "last", F.round(z, 3).alias("z"), F.round("slope", 4).alias("slope"), F.round(F.col("tail") / F.col("mean_y"), 3).alias("tail_ratio"))


def trajectory(weekly: DataFrame, key: str) -> DataFrame:
    """Label of each week against the one before: new, strengthening, weakening or stable."""
    before = F.lag("n").over(Window.partitionBy(key).orderBy("week"))
    label = F.when(F.col("before").isNull(), "new").when(F.col("n") > 1.15 * F.col("before"), "strengthening").when(F.col("n") < 0.85 * F.col("before"), "weakening").otherwise("stable")
    return weekly.withColumn("before", before).withColumn("trajectory", label)
