"""Counts, progress and the predicates that gate actions; each is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.names import percent_label
from pagemill.operators.catalog import selected


def _is(status: str) -> Column:
    return F.col("status") == status


def _exportable() -> Column:
    return _is("completed") & (F.col("ocr_text") != "")


def total_progress() -> Column:
    """Share of items that ended, well or not; 0 without items."""
    return F.coalesce(F.count_if(_is("completed") | _is("failed")) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))


def status_summary(items: DataFrame) -> DataFrame:
    """One row: counts, progress, its labels, and whether start and export are offered."""
    done = F.count_if(_is("completed"))
    n = F.count(F.lit(1))
    return items.agg(
        n.alias("items"),
        done.alias("completed"),
        F.count_if(_is("failed")).alias("failed"),
        total_progress().alias("total_progress"),
        percent_label(total_progress()).alias("percent"),
        F.concat_ws("/", done.cast("string"), n.cast("string")).alias("done_label"),
        F.coalesce(~F.every(_is("completed")), F.lit(False)).alias("can_start"),
        (done > 0).alias("can_export"),
    )


def selection_summary(items: DataFrame, selection: DataFrame) -> DataFrame:
    """One row about the selected items; "all" predicates hold on an empty selection."""
    return selected(items, selection).agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_if(_is("completed")).alias("completed"),
        F.coalesce(F.every(_is("completed")), F.lit(True)).alias("all_completed"),
        F.coalesce(F.every(_is("failed")), F.lit(True)).alias("all_failed"),
        F.coalesce(F.some(_exportable()), F.lit(False)).alias("any_exportable"),
    )
