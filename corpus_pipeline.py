"""Corpus pipeline: quality rules, language ID, near-duplicate removal,
redaction of personal data and packing into training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again before the next one.  All but the last keep the columns of
``docs``, whatever they are besides doc_id, text, lang and n_chars.  Stages
keep what their operators define for nulls, empty texts and repeated rows; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pivotspark.llm import language_id, packing, pii, quality_rules, simhash
from pivotspark.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table."""
    return quality_rules.keep_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages, by a network trained on a
    bounded sample of the labelled ones."""
    return language_id.keep_documents(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest doc_id."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences that hold all documents."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("language_id", language), ("simhash_near_dedup", near_duplicates),
          ("pii", personal_data), ("packing", pack)]

# Training, fingerprints and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents in ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
