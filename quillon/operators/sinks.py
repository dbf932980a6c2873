"""Writes as DataFrames: keys, inserts, upserts, carried state, purged copies, merged labels, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def surrogate_key(text: Column) -> Column:
    """63-bit key: the first eight bytes of the SHA-256, without the sign bit."""
    h = F.sha2(text, 256)
    top = F.conv(F.substring(h, 1, 1), 16, 10).cast("int") % 8
    return F.conv(F.concat(top.cast("string"), F.substring(h, 2, 15)), 16, 10).cast("long")


def insert_absent(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows, one of each key, that the target lacks: what a run has to append."""
    return rows.dropDuplicates(key).join(target.select(*key), key, "left_anti")


def upserted(target: DataFrame, rows: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Target and rows merged on the key, which is unique on either side; `change` tells what became of each."""
    new = rows.select(*key, *(F.col(v).alias(f"new_{v}") for v in values), F.lit(True).alias("is_new"))
    old = target.select(*key, *values, F.lit(True).alias("is_old"))
    change = F.when(F.col("is_new") & F.col("is_old"), "updated").when(F.col("is_new"), "inserted").otherwise("kept")
    merged = [F.when(F.col("is_new"), F.col(f"new_{v}")).otherwise(F.col(v)).alias(v) for v in values]
    return old.join(new, key, "full").select(*key, *merged, change.alias("change"))


def carried(rows: DataFrame, before: DataFrame, key: list[str], state: dict[str, object]) -> DataFrame:
    """Rebuilt rows with the state columns of their predecessors, or the defaults given."""
    old = before.select(*key, *(F.col(c).alias(f"old_{c}") for c in state))
    joined = rows.join(old, key, "left")
    return joined.select(*(F.col(c) for c in rows.columns), *(F.coalesce(F.col(f"old_{c}"), F.lit(v)).alias(c) for c, v in state.items()))


def purged(rows: DataFrame, digest: Column, key: str, copies: Column) -> DataFrame:
    """The earliest row of each digest, with how many rows it stands for besides itself."""
    return rows.groupBy(digest.alias("digest")).agg(F.min(key).alias(key), (F.count("*") - 1 + F.sum(copies)).alias("duplicate_count"))


def merged_labels(signals: DataFrame, drug: Column, event: Column, order: list[str]) -> DataFrame:
    """One signal per canonical (drug, event): the one with the largest of the order columns."""
    rest = [c for c in signals.columns if c not in ("drug", "event")]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return signals.groupBy(drug.alias("drug"), event.alias("event")).agg(best.alias("s"), F.count("*").alias("n_merged")).select("drug", "event", "s.*", "n_merged")


def alerts(signals: DataFrame, severity: Column, spike: Column, sdr: Column) -> DataFrame:
    """One alert per signal with its reasons; a strong signal alerts where nothing else does."""
    first = F.concat_ws(", ", F.when(severity.isin("Critical", "High"), F.concat(F.lit("severity "), severity)), F.when(spike, F.lit("spike")), F.when(sdr, F.lit("SDR")))
    reasons = F.when(first != "", first).when(F.col("strength") == "STRONG", F.lit("strong"))
    return signals.select("drug", "event", reasons.alias("reasons")).where("reasons is not null")
