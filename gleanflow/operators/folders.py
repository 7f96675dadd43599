"""Folders in the shared directory: new ones, stored rows, and names through Spark's own file systems (any store that Spark reads)."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def full_path(spark: SparkSession, path: str) -> str:
    """The path with its store, as file scans spell it."""
    where, store = _at(spark, path)
    return store.makeQualified(where).toString()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, sorted; none if it is not there."""
    where, store = _at(spark, path)
    if not store.exists(where):
        return []
    return sorted(found.getPath().getName() for found in store.listStatus(where))


def committed(spark: SparkSession, path: str) -> bool:
    """True if a Spark job finished writing this folder."""
    where, store = _at(spark, f"{path}/_SUCCESS")
    return store.exists(where)


def remove_folder(spark: SparkSession, path: str) -> None:
    where, store = _at(spark, path)
    store.delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a local one only for a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/gleanflow-{uuid.uuid4()}"


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="gleanflow-")


def staged(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, written once."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
