"""The text sink: one UTF-8 file, written beside its target and renamed."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame

from pagemill.operators.export import export_chunks
from pagemill.settings import Settings


def _bytes(chunks: DataFrame, separator: str) -> Iterator[bytes]:
    """The export piece by piece; ``toLocalIterator`` holds one partition at a time, so an export larger than memory works."""
    wrote = False
    for row in chunks.toLocalIterator():
        yield ((separator if wrote else "") + row.chunk).encode("utf-8", "surrogatepass")
        wrote = True


def _to_disk(parts: Iterator[bytes], target: str) -> bool:
    made, wrote = "", False
    try:
        handle, made = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(target)), prefix=".export-")
        with os.fdopen(handle, "wb") as out:
            for part in parts:
                out.write(part)
                wrote = True
        if wrote:
            os.replace(made, target)
        return wrote
    except OSError:
        return False
    finally:
        with contextlib.suppress(OSError):
            os.unlink(made)


def _to_store(parts: Iterator[bytes], target: str, chunks: DataFrame) -> bool:
    """Through Hadoop's file systems, so into any store that Spark writes to."""
    spark = chunks.sparkSession
    jvm, wrote = spark.sparkContext._jvm, False
    at = jvm.org.apache.hadoop.fs.Path(target)
    made = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".export-{uuid.uuid4().hex}")
    try:
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(at.getParent()):
            return False
        out = store.create(made)
        try:
            for part in parts:
                out.write(bytearray(part))
                wrote = True
        finally:
            out.close()
        if wrote:
            store.delete(at, False)  # a rename doesn't replace a file everywhere
            wrote = bool(store.rename(made, at))
        else:
            store.delete(made, False)
        return wrote
    except Py4JJavaError as e:
        if not jvm.java.io.IOException._java_lang_class.isInstance(e.java_exception):
            raise
        return False


def write_export(items: DataFrame, target: str, settings: Settings = Settings(), ids: DataFrame | None = None) -> bool:
    """Stream the exported chunks in order into one file: a path on the driver's disk, or a URI in any store.

    No trailing line end is added. Nothing to export: no file, False. A failed write leaves the old file and
    gives False; a folder that isn't there is such a failure.
    """
    chunks = export_chunks(items, settings, ids)
    parts = _bytes(chunks, settings.separator.value)
    return _to_store(parts, target, chunks) if "://" in target else _to_disk(parts, target)
