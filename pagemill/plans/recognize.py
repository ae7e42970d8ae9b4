"""The recognition call-out: bytes of an item to pages to lines to one text, in Arrow batches, errors kept per item.

No OCR engine is part of this repository. ``StubRecognizer`` decodes UTF-8 fixtures and stands in for one
in tests and queries; ``NoBackend`` is the slot for a real engine.

An item is opened (decoded), its pages come one by one, and each is recognised on its own, so a task holds one
item's bytes, one page and the text so far. Progress of an item is 0 until it is opened; an image then stands
at 0.2, a PDF at the share of its pages up to the last recognised one; an item that fails keeps what it had.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.names import extension
from pagemill.settings import Settings

# Fixed value: the message of an item that can't be loaded.
LOAD_FAILED = "无法加载图片文件"
# Fixed value: the progress of an image that is decoded and not yet recognised.
DECODED = 0.2

_RESULT = "id string, text string, error string, progress double"
_BATCH_ROWS, _BATCH_CHARS = 2000, 4 << 20


class CannotLoad(Exception):
    """The bytes aren't what the item's type promises."""


class Opened(NamedTuple):
    """An item's pages: how many it says it has, and each page as the recogniser wants it, None where it can't be drawn."""

    count: int
    pages: Iterable[object | None]


class Recognizer(Protocol):
    def open(self, content: bytes, ext: str) -> Opened:
        """Decodes an item: an image has one page. Raises ``CannotLoad`` where the bytes can't be decoded."""

    def lines(self, page: object, settings: Settings) -> list[str]:
        """Lines of a page, the best candidate of each. Raises for a failed item."""


class StubRecognizer:
    """A stub, no recognition: UTF-8 bytes, form feed between pages, markers for failures and pages that can't be drawn."""

    def __init__(self, fail_marker: str = "!fail", bad_page: str = "!bad", no_page: str = "!none"):
        self.fail_marker, self.bad_page, self.no_page = fail_marker, bad_page, no_page

    def open(self, content: bytes, ext: str) -> Opened:
        try:
            text = content.decode("utf-8")
        except UnicodeDecodeError as e:
            raise CannotLoad from e
        if text.startswith(self.fail_marker):
            raise ValueError("stub: marked as failing")
        pages = (text.split("\f") if ext == "pdf" else [text]) if text else []
        return Opened(len(pages), (None if p.startswith(self.no_page) else p for p in pages))

    def lines(self, page: object, settings: Settings) -> list[str]:
        if str(page).startswith(self.bad_page):
            raise ValueError("stub: bad page")
        return str(page).split("\n")


class NoBackend:
    """Stands where a real engine would."""

    def open(self, content: bytes, ext: str) -> Opened:
        raise RuntimeError("no OCR backend installed")

    def lines(self, page: object, settings: Settings) -> list[str]:
        raise RuntimeError("no OCR backend installed")


def read_bytes(path: str) -> bytes:
    """Default loader: any file system that pyarrow opens."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with store.open_input_stream(name) as f:
        return f.read()


def recognize_item(content: bytes, ext: str, recognizer: Recognizer, settings: Settings) -> tuple[str | None, str | None, float]:
    """(text, error, progress) of one item: lines to pages to one text, in order; no pages give the empty text. One bad page fails its item."""
    progress, texts = 0.0, []
    try:
        opened = recognizer.open(content, ext)
        if ext != "pdf":
            progress = DECODED
        for number, page in enumerate(opened.pages, 1):
            if page is None:
                continue
            texts.append("\n".join(recognizer.lines(page, settings)))
            if ext == "pdf":
                progress = number / opened.count
    except CannotLoad:
        return None, LOAD_FAILED, progress
    except Exception as e:
        return None, str(e) or type(e).__name__, progress
    return "\n\n".join(texts), None, 1.0


def recognize(work: DataFrame, recognizer: Recognizer, settings: Settings, load: Callable[[str], bytes] | None = read_bytes) -> DataFrame:
    """(id, text, error, progress) for items (id, path[, content]), a row each; a failed item has an error and no text.

    Texts are put together where they are recognised, so nothing is shuffled. Nothing raises out of the task.
    """
    given = "content" in work.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            types = (pa.string(), pa.string(), pa.string(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["id", "text", "error", "progress"])

        rows, held = [], 0
        for some in batches:
            ids, exts, values = some.column("id").to_pylist(), some.column("ext").to_pylist(), some.column("content" if given else "path")
            for k, (item, ext) in enumerate(zip(ids, exts, strict=True)):
                try:
                    content = values[k].as_py() if given else load(values[k].as_py())
                    if content is None:
                        raise OSError
                except Exception:
                    rows.append((item, None, LOAD_FAILED, 0.0))
                else:
                    rows.append((item, *recognize_item(bytes(content), ext, recognizer, settings)))
                held += len(rows[-1][1] or "")
                if len(rows) >= _BATCH_ROWS or held >= _BATCH_CHARS:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    columns = ["id", F.lower(extension(F.col("path"))).alias("ext"), "content" if given else "path"]
    return work.select(*columns).mapInArrow(run, _RESULT)


__all__ = ["DECODED", "LOAD_FAILED", "CannotLoad", "NoBackend", "Opened", "Recognizer", "StubRecognizer", "read_bytes", "recognize", "recognize_item"]
