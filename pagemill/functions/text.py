"""The text clean-up rules as column expressions; all stay inside code generation or built-in array functions.

Rules run in a fixed order, as trimming can create blank runs and must not create hyphen breaks:
hyphen breaks, trimming, blank runs, merging.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.settings import Settings

# Space separators and the tab; neither CR nor line feed. \A and \z, as $ also matches before a last line end.
_EDGE = r"\A[\p{Zs}\t]+|[\p{Zs}\t]+\z"
# CR LF counts as one character, so no line ends there.
_LINE_END = r"(?<!\r)\n"


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, _LINE_END, -1), lambda line: F.regexp_replace(line, _EDGE, ""))


def join_hyphen_breaks(text: Column) -> Column:
    """Delete every hyphen followed by a line feed."""
    return F.replace(text, F.lit("-\n"), F.lit(""))


def trim_lines(text: Column) -> Column:
    """Strip both ends of each line; empty lines stay."""
    return F.array_join(_lines(text), "\n")


def collapse_blank_runs(text: Column) -> Column:
    """Turn three or more line feeds in a row into two."""
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def merge_lines(text: Column) -> Column:
    """Strip lines, drop the empty ones and join the rest with a space."""
    return F.array_join(F.filter(_lines(text), lambda line: line != ""), " ")


def clean(text: Column, settings: Settings) -> Column:
    """The rules that the settings ask for, in their fixed order."""
    for wanted, rule in (
        (settings.remove_hyphen_breaks, join_hyphen_breaks),
        (settings.trim_whitespace, trim_lines),
        (settings.remove_empty_lines, collapse_blank_runs),
        (settings.merge_line_breaks, merge_lines),
    ):
        if wanted:
            text = rule(text)
    return text
