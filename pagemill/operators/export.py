"""Export and copy: which text goes out, in which order, under which name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.names import file_name, stem
from pagemill.operators.catalog import exportable, selected
from pagemill.settings import Settings


def _chunk(settings: Settings) -> Column:
    if not settings.include_filename:
        return F.col("ocr_text")
    return F.concat(F.lit("=== "), file_name(F.col("path")), F.lit(" ===\n"), F.col("ocr_text"))


def export_chunks(items: DataFrame, settings: Settings = Settings(), ids: DataFrame | None = None) -> DataFrame:
    """(ord, chunk) of what is exported; range-sorted by ``ord``, so a sink can stream it in order."""
    return exportable(items, ids).select("ord", _chunk(settings).alias("chunk")).orderBy("ord")


def export_text(items: DataFrame, settings: Settings = Settings(), ids: DataFrame | None = None) -> DataFrame:
    """One row (text); null if nothing is exported.

    The result is one value, so it must fit in one; use ``write_export`` for large catalogs.
    """
    joined = F.expr(f"listagg(chunk, '{_quoted(settings.separator.value)}') WITHIN GROUP (ORDER BY ord)")
    return exportable(items, ids).select("ord", _chunk(settings).alias("chunk")).agg(joined.alias("text"))


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\f", "\\u000C")


def export_name(items: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row (name): the stem of the only exported item, or a fixed name for several; null for none."""
    n = F.count(F.lit(1))
    only = F.concat(F.min_by(stem(F.col("path")), "ord"), F.lit("_OCR.txt"))
    return exportable(items, ids).agg(F.when(n == 1, only).when(n > 1, F.lit("Batch_Results.txt")).alias("name"))


def copy_selected(items: DataFrame, selection: DataFrame) -> DataFrame:
    """One row (text): completed texts of the selection, empty ones included; no row if the joined text is empty."""
    done = selected(items, selection).where("status = 'completed'")
    return done.agg(F.expr(r"listagg(ocr_text, '\n\n') WITHIN GROUP (ORDER BY ord)").alias("text")).where("text <> ''")


def copy_one(items: DataFrame, item_id: str) -> DataFrame:
    """The item's text in any state; no row if it is empty."""
    return items.where((F.col("id") == item_id) & (F.col("ocr_text") != "")).select(F.col("ocr_text").alias("text"))
