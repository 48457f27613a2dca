"""The folder that driver and executors share, tables written to cut a lineage, and paths by Spark's own file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set on a single machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.gettempdir() + "/walflow_shared"
    return where.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _path(spark, path)
    return store.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    store, place = _path(spark, path)
    store.delete(place, True)
