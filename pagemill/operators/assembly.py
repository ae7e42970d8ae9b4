"""Lines to pages and pages to documents, in an explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_candidates(observations: DataFrame) -> DataFrame:
    """(id, page_num, line_no, candidates array<string>) to lines with the first candidate; without one they go."""
    first = F.get("candidates", F.lit(0))
    return observations.select("id", "page_num", "line_no", first.alias("text")).where(F.col("text").isNotNull())


def assemble_pages(lines: DataFrame) -> DataFrame:
    """(id, page_num, line_no, text) to (id, page_num, text), lines joined by a line feed."""
    return lines.groupBy("id", "page_num").agg(F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY line_no)").alias("text"))


def assemble_documents(pages: DataFrame) -> DataFrame:
    """(id, page_num, text) to (id, text), pages joined by an empty line; null pages are skipped."""
    return pages.groupBy("id").agg(
        F.coalesce(F.expr("listagg(text, '\n\n') WITHIN GROUP (ORDER BY page_num)"), F.lit("")).alias("text")
    )
