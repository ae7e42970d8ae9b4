"""Listing of files and folders through Hadoop's file systems, so any store that Spark reads works.

Spark's own file sources skip names that start with a dot or an underscore even if they are asked for,
so paths are listed here and their bytes are read in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, length long"


def _length(fs, status) -> int | None:
    """Bytes of a file, or of all files in a folder at any depth; None for a folder that can't be read."""
    if not status.isDirectory():
        return int(status.getLen())
    try:
        return int(fs.getContentSummary(status.getPath()).getLength())
    except Exception:
        return None


def _listed(spark: SparkSession, path: str, include_hidden: bool, include_folders: bool) -> Iterable[tuple[str, int | None]]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        top = fs.getFileStatus(at)
        found = list(fs.listStatus(at)) if top.isDirectory() else [top]
    except Exception:  # a path that can't be read contributes nothing
        return []
    inside = top.isDirectory()
    rows = [(x.getPath(), x) for x in found if include_folders or not x.isDirectory()]
    return [
        (str(p.toString()), _length(fs, x))
        for p, x in rows
        if not inside or include_hidden or not p.getName().startswith(".")
    ]


def list_paths(spark: SparkSession, paths: Iterable[str], include_hidden: bool = True, include_folders: bool = False) -> DataFrame:
    """(path, length) of files, and of the files directly inside folders (one level), sorted by path.

    ``include_hidden`` says whether a folder's dot-files count: True for a file picker, False for a drop.
    With ``include_folders`` a folder inside a folder is a row as well, with the bytes of all files in it, as a table of
    many files is one; its length is null where it can't be read.
    Paths that can't be read contribute nothing. A file given twice is listed twice.
    """
    rows = sorted((row for path in paths for row in _listed(spark, path, include_hidden, include_folders)), key=lambda row: row[0])
    return spark.createDataFrame(rows, SCHEMA)
