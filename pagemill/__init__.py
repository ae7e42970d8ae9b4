"""Batch document-text processing on Spark: catalog, recognition runs, clean-up, assembly and export."""

from pagemill.settings import Engine, Separator, Settings

__all__ = ["Engine", "Separator", "Settings"]
