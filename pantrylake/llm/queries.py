"""One query for each operator over its whole table, and the SQL that expresses it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pantrylake.llm.common import table


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, from its prefix counts."""
    from pantrylake.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages that occur more than once, and where."""
    from pantrylake.llm.passages import repeats

    return repeats(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    from pantrylake.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    from pantrylake.llm.quality import score

    return score(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from pantrylake.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data spans of every document."""
    from pantrylake.llm.pii import digest, find

    return digest(find(table(spark, sf_dir, "documents")))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    from pantrylake.llm.near_dup import classes

    return classes(table(spark, sf_dir, "documents"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to it."""
    from pantrylake.llm.piece_codec import encode

    return encode(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that occurs in it."""
    from pantrylake.llm.decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition rules on every document."""
    from pantrylake.llm.repetition import judge

    return judge(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
