"""The corpus pipeline: language ID, near-dedup, PII, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, whatever further
columns there are.

Defined results: language ID drops null, blank and letterless texts and keeps everything else;
near-dedup keeps of equal rows, of rows with one id and equal texts, and of ties the one with the
smallest id, and rows of one id with different texts; PII and mixing keep every row (mixing repeats
or drops by its rates); packing gives a row for each row, with null places for texts without words;
empty tables give empty tables; without labels mixing keeps all rows once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common, language_id, mixing, near_dedup, packing, pii


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those with a letter; the prediction fills a missing lang."""
    return language_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans with personal data replaced by their kind."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the domains to their target weights."""
    return mixing.draw(docs, common.load(spark, sf_dir, "labels"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Buckets, batches and slots."""
    return packing.op4(spark, docs)


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("pii", personal_data), ("mixing", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    with common.scope() as keep:
        for name, stage in STAGES:
            docs = common.materialize(stage(spark, docs, sf_dir), name)
        return keep(docs)


#: Fitted models decide in most stages, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None
