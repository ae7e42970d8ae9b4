"""Beyond the desktop scope: continuous import of a stream of paths into a catalog folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.catalog import SCHEMA, importable, new_items, unseen


def continuous_import(paths: DataFrame, catalog_dir: str, checkpoint_dir: str, **trigger) -> StreamingQuery:
    """Append new items for a stream of (path, length); a batch writes its own folder, so a replayed batch replaces itself.

    ``ord`` is batch * 2^40 plus the number inside the batch: ordered, without reading the catalog's maximum.
    """

    def append(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(SCHEMA + ", batch long").option("recursiveFileLookup", "false").parquet(catalog_dir).where(f"batch <> {k}")
        fresh = new_items(unseen(importable(batch), known), f"stream-{k}", k << 40)
        fresh.write.mode("overwrite").parquet(f"{catalog_dir}/batch={k}")

    jvm, conf = paths.sparkSession.sparkContext._jvm, paths.sparkSession.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(catalog_dir)
    at.getFileSystem(conf).mkdirs(at)
    return paths.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"availableNow": True})).start()
