"""Deterministic text operators: hashes, scrubbing, markup, n-gram containment, fuzzy and vector matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"


def fold_key(text: Column) -> Column:
    """Upper case, ASCII letters and digits only."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def scrub(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[EMAIL]"), IPV4, "[IP]")


def strip_markup(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "[ \t\r\n]+", " "))


def first_by_hash(docs: DataFrame) -> DataFrame:
    """doc_id, the smallest doc_id with the same folded text, and whether it is kept. Only hashes are shuffled."""
    rows = docs.select("doc_id", F.md5(fold_key(F.coalesce("text", F.lit("")))).alias("h"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "h").select("doc_id", "first_id", (F.col("doc_id") == F.col("first_id")).alias("kept"))


def shared_grams(docs: DataFrame, passages: DataFrame, size: int = 8) -> DataFrame:
    """(doc_id, item_id, n): different word n-grams of benchmark passages that a document holds."""

    def grams(df: DataFrame, key: str) -> DataFrame:
        w = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
        at = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
        rows = df.select(key, w.alias("w")).where(F.size("w") >= size)
        return rows.select(key, F.explode(F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.slice("w", i, size))))).alias("gram"))

    return grams(docs, "doc_id").join(grams(passages, "item_id"), "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("n"))


def fuzzy(terms: DataFrame, catalog: DataFrame, cutoff: int = 3) -> DataFrame:
    """Best catalog entry of each term by edit distance among those with the same first letter."""
    key = lambda c: F.substring(F.upper(c), 1, 1)
    pairs = terms.withColumn("k", key("term")).join(catalog.withColumn("k", key("entry")), "k")
    pairs = pairs.withColumn("distance", F.levenshtein(F.upper("term"), F.upper("entry"))).where(F.col("distance") <= cutoff)
    first = F.row_number().over(Window.partitionBy("term").orderBy("distance", "entry"))
    return pairs.withColumn("r", first).where("r = 1").select("term", "entry", "distance")
