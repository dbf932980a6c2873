"""Operational reports: headline counts, roll-ups, percentiles, histograms, paging, evaluation, audit chain, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def headline(posts: DataFrame) -> DataFrame:
    urgent = F.col("severity").isin("1-URGENT", "2-HIGH")
    n = F.count("*")
    return posts.agg(n.alias("n_posts"), F.count_if("ae_flag").alias("n_ae"), F.count_if(urgent).alias("n_urgent"), F.countDistinct("author").alias("n_authors"), F.round(F.try_divide(F.count_if("ae_flag"), n), 4).alias("ae_rate"))


def marginals(posts: DataFrame) -> DataFrame:
    """Counts by region, by country, by severity and over all, in one grouping-sets pass."""
    from pyspark.sql.functions import grouping_id

    sets = [["region"], ["country"], ["severity"], []]
    out = posts.groupingSets([[F.col(c) for c in s] for s in sets], "region", "country", "severity").agg(F.count("*").alias("n"), F.count_if("ae_flag").alias("n_ae"), grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "region").when(F.col("g") == 5, "country").when(F.col("g") == 6, "severity").otherwise("all")
    return out.select(level.alias("level"), F.coalesce("region", "country", "severity", F.lit("all")).alias("label"), "n", "n_ae")


def overview(posts: DataFrame) -> DataFrame:
    """Series by day, week or month, the grain following from the number of days."""
    by_day = posts.groupBy(F.col("posted_at").alias("day")).agg(F.count("*").alias("n"), F.count_if("ae_flag").alias("n_ae"))
    days = by_day.agg(F.count("*").alias("days"))
    grain = F.when(F.col("days") > 156, "month").when(F.col("days") > 90, "week").otherwise("day")
    start = F.when(grain == "month", F.trunc("day", "month")).when(grain == "week", F.trunc("day", "week")).otherwise(F.col("day"))
    return by_day.crossJoin(F.broadcast(days)).groupBy(start.alias("start"), grain.alias("grain")).agg(F.sum("n").alias("n"), F.sum("n_ae").alias("n_ae"))


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    q = [F.round(F.percentile(value, F.lit(p)), 2).alias(f"p{round(p * 100)}") for p in (0.5, 0.9, 0.95)]
    return rows.groupBy(by).agg(F.count("*").alias("n"), *q)


def histogram(rows: DataFrame, value: Column, bands: int = 10) -> DataFrame:
    """Counts in equal bands of [0, 1], the last one closed; empty bands are there with 0."""
    spark = rows.sparkSession
    spine = spark.range(bands).select(F.col("id").cast("int").alias("band"))
    band = F.least(F.lit(bands - 1), F.floor(value * bands)).cast("int")
    return spine.join(rows.groupBy(band.alias("band")).agg(F.count("*").alias("n")), "band", "left").fillna(0, ["n"])


def page(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(size)


def confusion(rows: DataFrame, truth: Column, guess: Column) -> DataFrame:
    tp, fp, fn = F.count_if(truth & guess), F.count_if(~truth & guess), F.count_if(truth & ~guess)
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(2 * p * r / (p + r), 4).alias("f1"))


def author_entropy(rows: DataFrame, key: str, author: str) -> DataFrame:
    """Shannon entropy of a key's authors over log2 of its posts."""
    n = rows.groupBy(key, author).agg(F.count("*").alias("n"))
    share = n.withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    p = F.col("n") / F.col("total")
    by = share.groupBy(key).agg(F.max("total").alias("n_posts"), (-F.sum(p * F.log2(p))).alias("h"))
    return by.select(key, "n_posts", F.round(F.when(F.col("n_posts") > 1, F.col("h") / F.log2("n_posts")).otherwise(0.0), 4).alias("entropy"))


#: Fixed penalties of missing report fields.
PENALTIES = {"country": 0.10, "patient": 0.10, "outcome": 0.20, "dose": 0.10, "indication": 0.15}


def completeness(rows: DataFrame, present: dict[str, Column]) -> Column:
    out = F.lit(1.0)
    for name, there in present.items():
        out = out * F.when(there, 1.0).otherwise(1 - PENALTIES[name])
    return F.round(out, 3)


def priority(strength: Column, severity: Column) -> Column:
    """Priority of 0 to 100 from strength and severity weights, with neutral novelty and velocity."""
    s = F.when(strength == "STRONG", 3).when(strength == "MODERATE", 2).otherwise(1)
    v = F.when(severity == "Critical", 4).when(severity == "High", 3).when(severity == "Medium", 2).otherwise(1)
    return F.round(F.least(F.lit(100.0), s * v * 2 * 1 / F.lit(108.0) * 100), 1)


def chain_links(rows: DataFrame, key: Column, content: list[str]) -> DataFrame:
    """Content hash of each row and the hash linking it to the row before by key, whose content hash it names."""
    digest = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in content)), 256)
    rows = rows.withColumn("content_hash", digest)
    before = F.lag("content_hash", 1, "0" * 64).over(Window.partitionBy("drug").orderBy(key))
    return rows.withColumn("link_hash", F.sha2(F.concat(before, F.lit(":"), F.col("content_hash")), 256))
