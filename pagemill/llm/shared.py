"""Shared folders: intermediate tables and files that all executors must see."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder; where that is unset, under the warehouse.

    Executors can be lost at any time, so nothing that is read again lives in a machine's own folder. The
    folder goes when the driver ends.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{top.rstrip('/')}/pagemill/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return at.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage is cut, each row is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark, name)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*done: DataFrame) -> None:
    """Removes the files of stored tables that nothing reads any more, so that they don't wait for the driver's end."""
    for df in done:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            if "/pagemill/" in folder:  # only what ``stored`` wrote
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct that files can hold: a column without a type is kept as text."""
    return F.struct(*(F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, NullType) else F.col(f"`{f.name}`") for f in docs.schema))


def row_columns(docs: DataFrame, row: str = "row") -> list[Column]:
    """The columns of ``whole_row`` as they were."""
    return [F.lit(None).alias(f.name) if isinstance(f.dataType, NullType) else F.col(f"{row}.`{f.name}`") for f in docs.schema]
