"""Lineage cuts for iterative jobs.

A reliable ``Dataset.checkpoint()`` runs its input twice (one job to compute,
one to write the checkpoint files) unless the input is cached.  Writing the
intermediate as Parquet into the cluster's shared checkpoint directory and
reading it back is one job, columnar, and survives executor loss (the files
live on shared storage, not on an executor's local disk).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from marquee.session import scratch_dir


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh Parquet table under spark.checkpoint.dir; return the re-read table."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that is run here are deleted when it ends, not when its plan is collected as garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)
