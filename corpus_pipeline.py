"""The corpus pipeline: five stages, each of which takes what the one before it kept.

Every stage but the last returns the columns of ``documents``, whatever they are.
Rows with a null text fail the quality rules. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import decontamination, jaccard_join, packing, pii, quality_rules
from ledgerline.llm.common import stored
from ledgerline.sources import read_table

#: Near duplicates share four fifths of their shingles of five words.
NEAR = jaccard_join.Rule(size=5, percent=80)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    return jaccard_join.keep_one(docs, NEAR)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of ``benchmark``."""
    return decontamination.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1,024 tokens."""
    return packing.cut(packing.token_ids(docs))


STAGES = [
    ("quality_rules", good),
    ("jaccard_join", distinct),
    ("decontamination", clean),
    ("pii", private),
    ("packing", packed),
]

#: SQL expresses neither edit distance over all windows nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written, and read by the next stage."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
