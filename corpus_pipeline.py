"""A training-corpus pipeline: toxicity, quality rules, near-dedup, substring dedup and packing, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import read_table, rows_again, stored
from quillon.llm.packing import pack_documents
from quillon.llm.perplexity import quality_rules
from quillon.llm.simhash_anchor import one_of_each
from quillon.llm.suffix_dedup import deduplicated
from quillon.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, learned from labels. Verdicts come with their rows, here and below:
    doc_ids may be missing or repeated. Null and empty texts get the score of no evidence; an empty table stays empty."""
    scored = toxicity(docs, read_table(spark, sf_dir, "labels"), rows_too=True)
    return rows_again(scored.where("predicted = 0"), docs).select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside their language's perplexity band; null and empty texts fail."""
    return rows_again(quality_rules(docs, rows_too=True).where("kept"), docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of the least doc_id, a missing one being the largest;
    repeated rows are one group; texts without words are one group."""
    return one_of_each(docs).select(*COLUMNS)


def drop_repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated strings out of the texts; a document of which nothing is left stays, with an empty text."""
    return deduplicated(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document with its place in a sequence; null and empty texts are the end id alone."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeated_text),
    ("packing", pack),
]

#: SQL cannot express the stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over all that the one before kept, written and reread in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
