"""Results that are read again: written under the shared checkpoint folder, or the warehouse where that is unset."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def keep(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows written and read again: lineage is cut, each row is computed once. They go when the driver ends."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{top.rstrip('/')}/pagemill-runs/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
