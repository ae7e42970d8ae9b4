"""A recognition run over a catalog: snapshot, batches, stop, result as a new catalog snapshot."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import clean
from pagemill.operators.catalog import COLUMNS, import_paths, work_list
from pagemill.plans.recognize import Recognizer, read_bytes, recognize
from pagemill.settings import Settings


def apply_results(items: DataFrame, results: DataFrame, settings: Settings) -> DataFrame:
    """Merge (id, text, error, progress) into the catalog: completed with the cleaned text, or failed with the old text kept.

    A failed item keeps the progress it had reached. Items that are gone by now drop their result; items without
    a result stay as they are.
    """
    r = results.select("id", F.col("text").alias("_text"), F.col("error").alias("_error"), F.col("progress").alias("_progress"), F.lit(True).alias("_hit"))
    ok, bad = F.col("_hit") & F.col("_error").isNull(), F.col("_error").isNotNull()
    return items.join(r, "id", "left").withColumns({
        "status": F.when(bad, "failed").when(ok, "completed").otherwise(F.col("status")),
        "ocr_text": F.when(ok, clean(F.col("_text"), settings)).otherwise(F.col("ocr_text")),
        "error_message": F.when(bad, F.col("_error")).when(ok, None).otherwise(F.col("error_message")),
        "progress": F.when(ok, 1.0).when(bad, F.col("_progress")).otherwise(F.col("progress")),
    }).select(*COLUMNS)


def taken(items: DataFrame, work: DataFrame) -> DataFrame:
    """The catalog while the items of ``work`` are worked on: processing, progress 0, the old text kept."""
    marked = items.join(work.select("id", F.lit(True).alias("_hit")), "id", "left")
    hit = F.col("_hit").isNotNull()
    return marked.withColumns({
        "status": F.when(hit, "processing").otherwise(F.col("status")),
        "progress": F.when(hit, 0.0).otherwise(F.col("progress")),
    }).select(*COLUMNS)


class Run:
    """One run at a time. ``start`` freezes settings and work list; ``stop`` takes effect between batches."""

    def __init__(self, recognizer: Recognizer, settings: Settings = Settings(), batches: int = 1, load: Callable[[str], bytes] | None = read_bytes):
        self.recognizer, self.settings, self.batches, self.load = recognizer, settings, batches, load
        self._busy, self._stop = threading.Lock(), threading.Event()

    def stop(self) -> None:
        self._stop.set()

    def plan(self, items: DataFrame) -> DataFrame:
        """The new catalog, lazily, for the whole work list at once."""
        return apply_results(items, recognize(work_list(items, self.settings), self.recognizer, self.settings, self.load), self.settings)

    def _parts(self, work: DataFrame) -> list[DataFrame]:
        """The work list in slices of the catalog's order, so that a stop leaves the later items."""
        if self.batches == 1:
            return [work]
        first, last = work.agg(F.min("ord"), F.max("ord")).first()
        if first is None:
            return []
        part = F.floor((F.col("ord") - first) * self.batches / F.lit(last - first + 1))
        return [work.where(part == k) for k in range(self.batches)]

    def start(self, items: DataFrame, save: Callable[[DataFrame, int], DataFrame], watch: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """Work through the snapshot in ``batches`` parts by order; ``save`` stores a part's results and rereads them.

        ``watch`` gets the catalog as it stands each time a part is taken, whose items are then processing, and
        each time one is done. A call while a run is active returns the catalog unchanged.
        """
        if not self._busy.acquire(blocking=False):
            return items
        try:
            self._stop.clear()
            done = None
            now = lambda: items.select(*COLUMNS) if done is None else apply_results(items, done, self.settings)
            for k, part in enumerate(self._parts(work_list(items, self.settings))):
                if self._stop.is_set():
                    break
                if watch:
                    watch(taken(now(), part))
                got = save(recognize(part, self.recognizer, self.settings, self.load), k)
                done = got if done is None else done.unionByName(got)
                if watch:
                    watch(now())
            return now()
        finally:
            self._busy.release()

    @property
    def active(self) -> bool:
        return self._busy.locked()

    def import_paths(self, items: DataFrame, paths: DataFrame, batch: str, save: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
        """Import, then start if the settings ask for it and something is new; an active run goes on undisturbed."""
        catalog, fresh = import_paths(items, paths, batch)
        if self.settings.auto_start and not self.active and not fresh.isEmpty():
            return self.start(catalog, save)
        return catalog
