"""File names, sizes and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the four states, as they are displayed.
STATUS_LABELS = {"pending": "待处理", "processing": "识别中", "completed": "已完成", "failed": "失败"}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/?$", 1)


def extension(path: Column) -> Column:
    """As written; empty for names such as ``.png`` or ``b.``."""
    return F.regexp_extract(file_name(path), r"^.+\.([^./]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^./]+$", "$1")


def input_kind(path: Column) -> Column:
    """Which loader an item goes to: ``pdf`` page by page, ``image`` as a whole."""
    return F.when(F.lower(extension(path)) == "pdf", "pdf").otherwise("image")


def size_text(length: Column) -> Column:
    """KB with one decimal below 1024 KB, else MB; a dash if the size is unknown."""
    kb = length / F.lit(1024.0)

    def shown(value: Column, unit: str) -> Column:
        return F.concat(F.call_function("format_number", value, F.lit("0.0")), F.lit(unit))

    return F.when(length.isNull(), F.lit("—")).when(kb < 1024, shown(kb, " KB")).otherwise(shown(kb / 1024, " MB"))


def status_label(status: Column) -> Column:
    labels = [F.lit(x) for pair in STATUS_LABELS.items() for x in pair]
    return F.element_at(F.create_map(*labels), status)


def percent_label(progress: Column) -> Column:
    """Truncated, not rounded."""
    return (progress * 100).cast("int")
