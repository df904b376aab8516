"""A corpus pipeline of five stages; every stage reads what the one before it has written.

Language ID drops documents of unknown language; near-dedup keeps one document of each group;
decontamination drops contaminated documents and cuts benchmark passages out of the others; personal
data is replaced by its kind; packing assigns the pieces of what remains to sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpulse.llm import decontam, langid, neardup, packing, pii
from orgpulse.llm.common import table
from orgpulse.llm.queries import tokenizer_files
from orgpulse.staging import stage


def _with_length(docs: DataFrame) -> DataFrame:
    """The column `n_chars` follows a changed text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_length(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, **tokenizer_files())


STAGES = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", pack),
]

# Classifiers, tokenisation and bin packing are not SQL; tests/llm checks the operators and what each stage drops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
