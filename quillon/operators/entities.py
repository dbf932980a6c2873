"""Entity operators: similarities, tiered resolution without cross joins, negation, polarity, cohort strata, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .texts import fold_key


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def grams(text: Column, size: int = 3, left: int = 2, right: int = 1) -> Column:
    """Different character n-grams of a text padded with blanks."""
    padded = F.concat(F.lit(" " * left), text, F.lit(" " * right))
    at = F.sequence(F.lit(1), F.greatest(F.length(padded) - (size - 1), F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substring(padded, i, F.lit(size))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(term, entry, score) of texts with `score` of at least `least`: the edit ratio or 0.55 of the trigram Jaccard
    plus 0.45 of the edit ratio, whichever is larger.

    Candidates share a trigram, found by an equi-join on trigrams of different texts on both sides; pairs without a
    common trigram score by edits alone and are not looked for.
    """
    x = left.select("term").distinct().withColumn("g", grams(F.lower("term")))
    y = right.select("entry").distinct().withColumn("h", grams(F.lower("entry")))
    pairs = x.select("term", F.explode("g").alias("k")).join(y.select("entry", F.explode("h").alias("k")), "k").select("term", "entry").distinct()
    rows = pairs.join(x, "term").join(y, "entry")
    edits = edit_ratio(F.lower("term"), F.lower("entry"))
    score = F.round(F.greatest(edits, 0.55 * jaccard(F.col("g"), F.col("h")) + 0.45 * edits), 4)
    return rows.select("term", "entry", score.alias("score")).where(F.col("score") >= least)


def resolved(terms: DataFrame, catalog: DataFrame, least: float = 0.72) -> DataFrame:
    """Each different term's entry by the first tier that has one: exact, folded, similar; null where none has."""
    t, c = terms.select("term").distinct(), catalog.select("entry").distinct()
    exact = t.join(c, F.lower("term") == F.lower("entry")).select("term", "entry", F.lit(1).alias("tier"), F.lit(1.0).alias("score"))
    folded = t.join(c, fold_key(F.col("term")) == fold_key(F.col("entry"))).select("term", "entry", F.lit(2).alias("tier"), F.lit(1.0).alias("score"))
    near = similar(t, c, least).select("term", "entry", F.lit(3).alias("tier"), "score")
    best = F.row_number().over(Window.partitionBy("term").orderBy("tier", F.desc("score"), "entry"))
    found = exact.unionByName(folded).unionByName(near).withColumn("r", best).where("r = 1").drop("r")
    return t.join(found, "term", "left")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def negated_mentions(words: Column, term: str, cues: list[str], ends: list[str], reach: int = 6) -> Column:
    """How many mentions of the term have a cue among the `reach` words before, with no terminator after that cue."""

    def last(window: Column, of: list[str]) -> Column:
        return F.coalesce(F.array_max(F.transform(window, lambda w, i: F.when(w.isin(of), i + 1).otherwise(0))), F.lit(0))

    def negated(w: Column, i: Column) -> Column:
        window = F.slice(words, F.greatest(i - (reach - 1), F.lit(1)), F.least(i, F.lit(reach)))
        return F.when(w == term, last(window, cues) > last(window, ends)).otherwise(False)

    return F.size(F.filter(F.transform(words, negated), lambda x: x))


def polarity(words: Column, lexicon: dict[str, float]) -> tuple[Column, Column]:
    """Score s / sqrt(s^2 + 15) of the summed word weights, and its label."""
    weight = F.create_map(*(F.lit(x) for pair in lexicon.items() for x in pair))
    s = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(weight, w), F.lit(0.0)))
    score = F.round(s / F.sqrt(s * s + 15), 4)
    return score, F.when(score <= -0.05, "NEGATIVE").when(score >= 0.35, "POSITIVE").otherwise("NEUTRAL")


def by_strata(rows: DataFrame, strata: dict[str, Column], case: Column) -> DataFrame:
    """n and cases of each stratum; a row counts in every stratum whose predicate it meets. One pass."""
    names = F.filter(F.array(*(F.when(p, F.lit(n)) for n, p in strata.items())), lambda x: x.isNotNull())
    return rows.select(F.explode(names).alias("stratum"), case.alias("hit")).groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("hit").alias("a"))


def search(docs: DataFrame, terms: list[str], most: int) -> DataFrame:
    """The `most` documents with most of the terms in them, and which: the report of a search."""
    found = F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(F.lower("text"), t))
    return docs.select("doc_id", F.size(found).alias("n_terms"), F.concat_ws(",", found).alias("terms")).where("n_terms > 0").orderBy(F.desc("n_terms"), "doc_id").limit(most)
