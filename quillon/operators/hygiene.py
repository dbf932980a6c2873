"""Hygiene and matching of records: scrubbing, pseudonyms, canonical content, match predicates, gateways."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import fold_key

#: Fixed patterns of personal data, in the order in which they are replaced.
PATTERNS = {
    "URL": r"https?://\S+|www\.\S+",
    "EMAIL": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "UPI": r"\b[\w.-]{2,}@(?:okhdfcbank|oksbi|okaxis|okicici|paytm|ybl|upi)\b",
    "CARD": r"\b(?:\d[ -]*?){13,16}\b",
    "IBAN": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "NINO": r"\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]\b",
    "AADHAAR": r"\b\d{4}\s?\d{4}\s?\d{4}\b",
    "PAN": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "PHONE": r"(?<!\d)(?:\+?\d{1,3}[-.\s]?)?(?:\(\d{2,4}\)[-.\s]?)?(?:\d[-.\s]?){9,12}\d(?!\d)",
    "USER": r"(?<!\w)@\w{2,}",
}


def _replaced(text: Column, kind: str) -> Column:
    pattern = "(?U)" + PATTERNS[kind]
    if kind != "CARD":
        return F.regexp_replace(text, pattern, f"[{kind}]")
    valid = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda c: F.call_function("luhn_check", F.regexp_replace(c, "[^0-9]", "")))
    return F.aggregate(valid, text, lambda t, c: F.replace(t, c, F.lit("[CARD]")))


def scrub_rows(rows: DataFrame, text: str) -> DataFrame:
    """Rows with personal data in the text replaced by [KIND], and `kinds`, those found, in order.

    Card numbers must pass Luhn's check. Built-in expressions only; a null text stays null, with no kinds.
    """
    rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    for kind in PATTERNS:
        rows = rows.withColumn("_after", _replaced(F.col(text), kind))
        rows = rows.withColumn("kinds", F.when(F.col("_after") != F.col(text), F.array_append("kinds", F.lit(kind))).otherwise(F.col("kinds"))).withColumn(text, F.col("_after")).drop("_after")
    return rows


def hmac_sha256(key: bytes, text: Column) -> Column:
    """HMAC-SHA256 in lowercase hex, from two SHA-256 of padded keys (key of at most 64 bytes)."""
    inner, outer = (bytearray(b ^ pad for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), digest), 256)


def pseudonym(author: Column, key: bytes) -> Column:
    """HMAC of an author, but for what is a hash of 32 to 64 hex digits already."""
    return F.when(author.rlike("^[0-9a-f]{32,64}$"), author).otherwise(hmac_sha256(key, author))


def canonical(rows: DataFrame, names: list[str]) -> Column:
    """JSON of the named columns by sorted name, nulls left out: what content hashes are taken of."""
    return F.to_json(F.struct(*(F.col(n) for n in sorted(names))))


def soft_match(a: Column, b: Column) -> Column:
    """Equal, or one of five letters or more within the other; case does not count."""
    x, y = F.lower(a), F.lower(b)
    return (x == y) | ((F.length(x) >= 5) & F.contains(y, x)) | ((F.length(y) >= 5) & F.contains(x, y))


def folded_match(a: Column, b: Column) -> Column:
    x, y = fold_key(a), fold_key(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def in_scope(column: Column, scope: int) -> Column:
    """Rows of a scope and those of none."""
    return (column == scope) | column.isNull() | (column == 0)


def of_platform(platform: Column, names: list[str]) -> Column:
    """The platform itself or a part of it, written name/part or name_part."""
    return platform.rlike(f"^({'|'.join(names)})($|[/_])")


def confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(0.99), F.abs(score) * 0.9 + 0.1), 3)


def severity_bucket(severity: Column, strength: Column) -> Column:
    """Severity if it is known, else what the strength stands for."""
    return F.coalesce(severity, F.when(strength == "STRONG", "High").when(strength == "MODERATE", "Medium").otherwise("Low"))


def gateway(words: Column, known: list[str], dropped: list[str], cues: list[str], reach: int = 3) -> Column:
    """The different known words of a text in order, without dropped ones and those with a cue shortly before."""

    def passes(w: Column, i: Column) -> Column:
        before = F.slice(words, F.greatest(i - (reach - 1), F.lit(1)), F.least(i, F.lit(reach)))
        return F.when(w.isin(known) & ~w.isin(dropped) & ~F.exists(before, lambda b: b.isin(cues)), w)

    return F.array_distinct(F.array_compact(F.transform(words, passes)))


def tiered(terms: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each different term's entry: exact, else the longest entry that is a run of its words; null where none is.

    Runs of at most four words are looked up by an equi-join, so the catalogue is never held against every term.
    """
    t = terms.select("term").distinct()
    words = F.split(F.lower("term"), " +")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(4))), lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    found = t.select("term", F.explode(F.array_distinct(runs)).alias("entry")).join(catalog.select("entry").distinct(), "entry")
    exact = F.lower("term") == F.col("entry")
    best = F.max_by("entry", F.struct(exact, F.length("entry"), F.col("entry")))
    by = found.groupBy("term").agg(best.alias("entry"), F.when(F.max(exact), 1).otherwise(2).alias("tier"))
    return t.join(by, "term", "left")


def with_columns_added(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that an older table lacks, with their defaults; those that are there stay as they are."""
    return reduce(lambda df, kv: df if kv[0] in df.columns else df.withColumn(kv[0], F.lit(kv[1])), defaults.items(), rows)
