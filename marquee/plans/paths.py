"""What lies under a path, on whatever file system it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``; errors of the file system are raised."""
    fs, at = _at(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete what is at ``path``, if there is anything."""
    fs, at = _at(spark, path)
    fs.delete(at, True)


def latest_version(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The largest n (smaller than ``before``) of the finished tables ``v<n>`` under ``path`` (a finished write has _SUCCESS)."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = [int(n[1:]) for n in names if n[1:].isdigit() and n[0] == "v" and (before is None or int(n[1:]) < before) and exists(spark, f"{path}/{n}/_SUCCESS")]
    return max(done, default=None)
