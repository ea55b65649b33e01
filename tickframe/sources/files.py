"""Folders and files of any store that Spark reaches: names, and what is no longer needed."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder; none if it is missing."""
    store, there = _at(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(there)) if store.exists(there) else []


def exists(spark: SparkSession, path: str) -> bool:
    store, there = _at(spark, path)
    return store.exists(there)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds, or a file; a missing one is no error."""
    store, there = _at(spark, path)
    store.delete(there, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store."""
    store, there = _at(spark, path)
    return store.makeQualified(there).toString()
