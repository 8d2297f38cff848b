"""From raw documents to packed training sequences: language, near duplicates, personal data, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tradewake.llm import langid, mixing, packing, pii, simhash
from tradewake.session import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return langid.drop_unidentified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced in the texts."""
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target shares of tokens."""
    return mixing.sample(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", sequences),
]

# Trained models, fingerprints and tokenizers have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents below ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
