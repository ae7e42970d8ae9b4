"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import best_two_fit, langid, mix, simhash, templates
from pagemill.llm.shared import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null and empty ones among them, or whose language stays in doubt, go.

    Repeated rows go or stay together; very long texts are judged by all their windows; an empty table gives no
    rows. Further columns stay in this and all stages but the last.
    """
    return langid.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents stay in the first of them only; a document that loses all its lines goes.

    Null and empty texts stay. Rows that share an id never drop each other's lines, rows without an id come last.
    """
    return templates.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays: that with the smallest id, null last."""
    return simhash.distinct_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as, and cut to what, the mix takes of them.

    Null and empty texts aren't taken. Copies are rows that share an id. Null sources are a source, the last one.
    """
    return mix.mixed_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences.

    ``document`` tells rows apart that share an id. Null and empty texts are a piece of one token.
    """
    return best_two_fit.packed(docs, literals=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can't express a trained classifier or the fingerprints' hash; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
