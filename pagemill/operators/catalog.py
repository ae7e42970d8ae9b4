"""The item catalog: import, filters, selection and state changes.

A catalog is a DataFrame (ord, id, path, length, status, ocr_text, error_message, progress). Rows have
no order of their own in a DataFrame, so ``ord`` carries the order in which items came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.names import extension
from pagemill.settings import Settings
from pagemill.store import keep

# Extensions that can be imported.
EXTENSIONS = ("png", "jpg", "jpeg", "tiff", "tif", "bmp", "gif", "heic", "webp", "pdf")

COLUMNS = ("ord", "id", "path", "length", "status", "ocr_text", "error_message", "progress")
SCHEMA = "ord long, id string, path string, length long, status string, ocr_text string, error_message string, progress double"


def importable(paths: DataFrame) -> DataFrame:
    """Rows whose path has an accepted extension, in either case."""
    return paths.where(F.lower(extension(F.col("path"))).isin(*EXTENSIONS))


def unseen(paths: DataFrame, items: DataFrame) -> DataFrame:
    """Rows whose path isn't in the catalog. Repeats inside the batch stay."""
    return paths.join(items.select("path"), "path", "left_anti")


def new_items(paths: DataFrame, batch: str, first_ord: Column | int = 0) -> DataFrame:
    """Rows for paths (path, length), numbered by path within the batch; ids depend on batch and number only.

    Numbers come from a two-step count, not from one global window: range partitions are numbered within
    themselves and shifted by the counts of those before, so no single task holds all rows. The numbered rows are
    stored, so that both steps see the same partitions.
    """
    dealt = paths.select("path", "length").repartitionByRange("path").sortWithinPartitions("path", "length")
    numbered = keep(dealt.select("path", "length", F.monotonically_increasing_id().alias("_m")), "numbered")
    local = numbered.select("path", "length", F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_r"))
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per partition
    shifts = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_shift"))
    at = F.lit(first_ord) if isinstance(first_ord, int) else first_ord
    number = (at + F.col("_shift") + F.col("_r")).cast("long")
    return local.join(shifts, "_p").select(
        number.alias("ord"),
        F.sha2(F.concat_ws(":", F.lit(batch), number), 256).alias("id"),
        "path",
        F.col("length").cast("long"),
        F.lit("pending").alias("status"),
        F.lit("").alias("ocr_text"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(0.0).alias("progress"),
    )


def import_paths(items: DataFrame, paths: DataFrame, batch: str, dedupe_batch: bool = False) -> tuple[DataFrame, DataFrame]:
    """Filter, drop known paths, number and append: (new catalog, new rows)."""
    wanted = unseen(importable(paths), items)
    if dedupe_batch:
        wanted = wanted.dropDuplicates(["path"])
    top = items.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
    fresh = new_items(wanted, batch, top)
    return items.select(*COLUMNS).unionByName(fresh), fresh


def first_selected(items: DataFrame, selection: DataFrame) -> DataFrame:
    """One row with the id of the first selected item, null if there is none."""
    return selected(items, selection).agg(F.min_by("id", "ord").alias("id"))


def default_selection(selection: DataFrame, fresh: DataFrame) -> DataFrame:
    """The first new item, if nothing is selected; else the selection as it is."""
    first = fresh.agg(F.min_by("id", "ord").alias("id")).where("id is not null")
    return selection.select("id") if not selection.isEmpty() else first


def work_list(items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pending and failed items; completed ones too unless they are skipped."""
    states = ["pending", "failed"] + ([] if settings.skip_completed else ["completed"])
    return items.where(F.col("status").isin(*states))


def selected(items: DataFrame, selection: DataFrame) -> DataFrame:
    return items.join(selection.select("id"), "id", "left_semi")


def exportable(items: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Completed items with text. No ids, or an empty set of them, means all."""
    found = items.where((F.col("status") == "completed") & (F.col("ocr_text") != ""))
    return found if ids is None or ids.isEmpty() else selected(found, ids)


def retry(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Back to pending: text and error go, progress stays."""
    hit = F.col("_hit").isNotNull()
    marked = items.join(ids.select("id", F.lit(True).alias("_hit")).dropDuplicates(["id"]), "id", "left")
    return marked.withColumns({
        "status": F.when(hit, "pending").otherwise(F.col("status")),
        "ocr_text": F.when(hit, "").otherwise(F.col("ocr_text")),
        "error_message": F.when(hit, None).otherwise(F.col("error_message")),
    }).select(*items.columns)


def remove(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("id"), "id", "left_anti").select(*items.columns)


def clear(items: DataFrame) -> DataFrame:
    return items.where(F.lit(False))


def disjoint(selection: DataFrame, ids: DataFrame) -> bool:
    return selection.join(ids.select("id"), "id", "left_semi").isEmpty()


def remove_selected(items: DataFrame, selection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog without the selected items, the selection that follows)."""
    return remove(items, selection), next_selection(items, selection, selection)


def next_selection(items: DataFrame, selection: DataFrame, removed: DataFrame) -> DataFrame:
    """Selection after a removal, as rows of ids.

    If no selected item goes, it stays as it is. Else it is the first remaining item after the last removed
    one, else the first remaining, else none. Two aggregations; no window over all rows.
    """
    gone = items.join(removed.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left").join(
        selection.select("id").distinct().withColumn("_sel", F.lit(True)), "id", "left"
    )
    marks = gone.agg(
        F.max(F.when(F.col("_gone"), F.col("ord"))).alias("_last"),
        F.coalesce(F.bool_or(F.col("_gone") & F.col("_sel")), F.lit(False)).alias("_moved"),
    )
    rest = gone.where("_gone is null").crossJoin(F.broadcast(marks))  # marks is one row
    target = rest.where("_moved").agg(
        F.coalesce(F.min_by("id", F.when(F.col("ord") > F.col("_last"), F.col("ord"))), F.min_by("id", "ord")).alias("id")
    ).where("id is not null")
    kept = gone.where("_sel").crossJoin(F.broadcast(marks)).where("not _moved").select("id")
    return target.unionByName(kept)
