"""Assessment of signals: causality checklist, benefit-risk verdicts, trust, evidence tiers, audits, paths and spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import grams

#: Fixed points of the ten checklist items: (yes, no); unknown gives none.
NARANJO = {1: (1, 0), 2: (2, -1), 3: (1, 0), 4: (2, -1), 5: (-1, 2), 6: (-1, 1), 7: (1, 0), 8: (1, 0), 9: (1, 0), 10: (1, 0)}
#: Fixed weights of evidence tiers.
TIER_WEIGHTS = {1: 1.0, 2: 0.7, 3: 0.35}


def naranjo(answers: dict[int, Column]) -> tuple[Column, Column]:
    """Score and category from answers that are true, false or null (unknown)."""
    points = (F.when(a.isNull(), 0).when(a, NARANJO[q][0]).otherwise(NARANJO[q][1]) for q, a in answers.items())
    score = reduce(lambda x, y: x + y, points)
    return score, F.when(score >= 9, "Definite").when(score >= 5, "Probable").when(score >= 1, "Possible").otherwise("Doubtful")


def harm_per_treated(base: Column, factor: Column, n: Column) -> Column:
    """Number needed to harm: one over the absolute risk increase, which is held within [0.0001, 0.5]."""
    risk = base * factor * (1 + F.least(n, F.lit(60)) / 30)
    return F.round(1 / F.greatest(F.lit(1e-4), F.least(F.lit(0.5), risk))).cast("long")


def benefit_verdict(benefit: Column, harm: Column, critical: Column, sure: Column) -> Column:
    """Favourable, Uncertain or Unfavourable; a certain critical harm needs four times its weight in benefit."""
    ratio = F.try_divide(benefit, harm)
    good = (harm <= 0) | ((ratio >= 1.8) & (benefit > harm))
    return F.when(good & critical & sure & (ratio < 4), "Uncertain").when(good, "Favourable").when(ratio >= 0.8, "Uncertain").otherwise("Unfavourable")


def balance(efficacy: Column, severe: Column) -> tuple[Column, Column]:
    """Response rate over the rate of severe events, and its band; no rate, no ratio."""
    ratio = F.round(F.try_divide(efficacy, severe), 2)
    band = F.when(ratio.isNull(), "not evaluable").when(ratio >= 5, "strongly favourable").when(ratio >= 1.5, "favourable").when(ratio >= 0.8, "balanced").otherwise("unfavourable")
    return ratio, band


MIX_PRIME = 4_294_967_311


def mixes(i: int) -> tuple[int, int]:
    """Factor and addend of the i-th hash function."""
    return (i + 1) * 2_654_435_761 % MIX_PRIME, (i + 1) * 40_503 * 65_537 % MIX_PRIME


def text_diversity(texts: DataFrame, key: str, text: str, functions: int = 8) -> DataFrame:
    """One less the mean Jaccard likeness of a key's texts by 4-grams; a key with one text has 1.

    The share of a key's pairs that agree on a min-hash estimates the likeness without bias, and is counted from the
    sizes of the groups of equal min-hashes: linear in the texts, no pairs are made. Null and empty texts are left out.
    """
    # one digest a gram; the hash functions are affine maps of it modulo a prime
    digest = lambda g: F.conv(F.substring(F.md5(g), 1, 7), 16, 10).cast("long")
    rows = texts.where(F.length(text) > 0).select(key, F.transform(F.array_distinct(grams(F.lower(text), 4, 0, 0)), digest).alias("g"))
    least = lambda i: F.array_min(F.transform("g", lambda g: (g * mixes(i)[0] + mixes(i)[1]) % MIX_PRIME))
    rows = rows.select(key, F.posexplode(F.array(*(least(i) for i in range(functions)))).alias("i", "h"))
    same = rows.groupBy(key, "i", "h").agg(F.count("*").alias("n"))
    by = same.groupBy(key, "i").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree"))
    like = F.sum("agree") / (functions * F.max("n") * (F.max("n") - 1))
    return by.groupBy(key).agg(F.when(F.max("n") < 2, 1.0).otherwise(1 - like).alias("diversity"))


def trust(entropy: Column, span_hours: Column, n: Column, diversity: Column) -> tuple[Column, Column]:
    spread = F.when(n < 2, 1.0).otherwise(F.least(F.lit(1.0), span_hours / 24))
    score = F.round(F.pow(entropy * spread * diversity, 1 / 3), 3)
    return score, F.when(score >= 0.7, "high").when(score >= 0.4, "moderate").when(score >= 0.15, "low").otherwise("sybil")


def credibility(precision: Column, recall: Column, f1: Column) -> Column:
    """Index of 0 to 100 from precision, recall, F1 and how close the first two are."""
    raw = 0.55 * f1 + 0.20 * precision + 0.15 * recall + 0.10 * (1 - F.least(F.lit(1.0), F.abs(precision - recall)))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw * 100)), 1)


def brighton(narrow: Column, n: Column) -> Column:
    return F.when(narrow & (n >= 4), 1).when(narrow, 2).otherwise(3)


def worry(sdr: Column, strength: Column, spike: Column, critical: Column) -> Column:
    strong = strength == "STRONG"
    return F.when((sdr & strong) | (spike & critical) | (strong & critical), "red").when(sdr | strong | (strength == "MODERATE") | spike | critical, "amber").otherwise("green")


def evidence_tier(text: Column, first: list[str], second: list[str]) -> Column:
    """1 if a marker of the first list is there, else 2 for the second list, else 3."""
    hit = lambda words: F.lower(text).rlike("|".join(words))
    return F.when(hit(first), 1).when(hit(second), 2).otherwise(3)


def audited(rows: DataFrame, keys: list[str], limits: dict[str, float]) -> DataFrame:
    """A row per signal and measure: its value, its limit and whether the value reaches that."""
    long = rows.unpivot(keys, [F.col(m).cast("double").alias(m) for m in limits], "measure", "value")
    least = F.create_map(*(F.lit(x) for m in limits.items() for x in m))[F.col("measure")]
    return long.withColumn("least", least).withColumn("passed", F.col("value") >= F.col("least"))


def typed_edges(*parts: tuple[DataFrame, Column, str, Column]) -> DataFrame:
    """(src, relation, dst) without repeats, from tables each with a source, a relation and a target."""
    rows = (df.select(src.alias("src"), F.lit(rel).alias("relation"), dst.alias("dst")).distinct() for df, src, rel, dst in parts)
    return reduce(DataFrame.unionByName, rows)


def walk(edges: DataFrame, relations: list[str]) -> DataFrame:
    """All paths along a sequence of relations: n0, n1, ...; an equi-join a step."""
    step = lambda i, r: edges.where(F.col("relation") == r).select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}"))
    return reduce(lambda a, b: a.join(b, list(set(a.columns) & set(b.columns))), [step(i, r) for i, r in enumerate(relations)])


def span_matches(gold: DataFrame, found: DataFrame, strict: bool = True) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of (doc, start, end, kind) spans; strict needs equal ends, relaxed an overlap.

    The relaxed form joins on (doc, kind): a text holds few spans of a kind.
    """
    g, f = gold.alias("g"), found.alias("f")
    here = (F.col("g.doc") == F.col("f.doc")) & (F.col("g.kind") == F.col("f.kind"))
    place = (F.col("g.start") == F.col("f.start")) & (F.col("g.end") == F.col("f.end")) if strict else (F.col("g.start") < F.col("f.end")) & (F.col("f.start") < F.col("g.end"))
    count = lambda a, b, how, name: a.join(b, here & place, how).agg(F.count("*").alias(name))
    one = count(f, g, "left_semi", "tp").crossJoin(count(f, g, "left_anti", "fp")).crossJoin(count(g, f, "left_anti", "fn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return one.select("tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 4).alias("f1"))


def hashed_vector(text: Column, size: int = 32) -> Column:
    """Counts of a text's different trigrams by the first 28 bits of their MD5, scaled to length one."""
    slot = F.transform(grams(F.lower(text), 3, 0, 0), lambda g: F.conv(F.substring(F.md5(g), 1, 7), 16, 10).cast("long") % size)
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slot, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(counts, lambda x: F.try_divide(x, norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def onset_days(text: Column) -> Column:
    """The first "N day(s)/week(s)/month(s)/year(s)" of a text in days."""
    found = r"([0-9]+(?:\.[0-9]+)?) ?(day|week|wk|month|year)"
    n, unit = F.regexp_extract(F.lower(text), found, 1), F.regexp_extract(F.lower(text), found, 2)
    scale = F.when(unit == "year", 365.0).when(unit == "month", 30.4).when(unit.isin("week", "wk"), 7.0).otherwise(1.0)
    return F.nullif(n, F.lit("")).cast("double") * scale


def any_date(text: Column) -> Column:
    """A date written yyyyMMdd, yyyy-MM-dd or as an ISO timestamp; null if none of them."""
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def age_years(age: Column, unit: Column) -> Column:
    """Age in years from a number and a unit code: 800 decades, 801 years, 802 months, 803 weeks, 804 days, 805 hours."""
    years = {"800": 10.0, "801": 1.0, "802": 1 / 12, "803": 1 / 52, "804": 1 / 365, "805": 1 / 8760}
    return age * reduce(lambda c, k: c.when(unit == k, years[k]), list(years)[1:], F.when(unit == "800", years["800"]))


def sampled(rows: DataFrame, by: str, key: str, most: int, seed: str) -> DataFrame:
    """At most so many rows of each group, those of the least hash of their key: the same ones in every run."""
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    return rows.withColumn("_h", order).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_h", key))).where(F.col("_r") <= most).drop("_h", "_r")


def top_list(item: Column, order: Column, most: int) -> Column:
    """Aggregate: a group's items by falling order, then by name, joined with commas, at most so many."""
    found = F.array_sort(F.collect_list(F.struct((-order).alias("o"), item.alias("v"))))
    return F.array_join(F.transform(F.slice(found, 1, most), lambda s: s["v"]), ",")
