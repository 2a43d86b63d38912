"""Raw documents to a training mix: five stages, each an operator of ``tagloom.llm``.

Each stage gets the rows that the one before wrote, and all of their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import decontaminate, exact, language, mixing, neardup
from tagloom.llm.queries import remainder, table
from tagloom.llm.scratch import store

#: Least corrected share of known n-grams of a text in any of the languages.
COVERAGE = 0.15


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages.

    Those without a letter go, and those few of whose n-grams any language has. Each row is judged
    by its own text, whatever its id.
    """
    filters = language.fit(docs.where(remainder(4) != 2), "doc_id", "text", "lang")
    return language.known(docs, filters, COVERAGE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Where ids are null or repeat, rows are told apart by id and text.
    """
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, and how often."""
    return mixing.take(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: SQL cannot express n-gram filters, min-max hashing or hash thresholds.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
