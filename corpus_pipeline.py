"""The training-data pipeline: language, near-duplicates, benchmark leaks, personal data, then token ids.

Each stage takes all rows that the one before kept, with any further columns, whatever their names.  Null, empty and
letterless texts go in the first stage; rows are told apart by id and text, so a repeated row stays once and one id may
stand for several texts; a row without an id is treated like any other; very long texts are read whole; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pantrylake.llm import decontaminate, language_id, near_dup, piece_codec, pii
from pantrylake.llm.common import checkpointed, shrink_executors, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    shrink_executors(spark)
    return language_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    shrink_executors(spark)
    return near_dup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    shrink_executors(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    shrink_executors(spark)
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining document as piece ids."""
    shrink_executors(spark)
    return piece_codec.encode(docs)


STAGES = [
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: Neither the trained stages nor the encoding can be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each over what the one before has kept."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpointed(docs)
    return docs
