"""Page directory (O10): any page of a fixed order from one or two partitions.

Offset paging reads and sorts everything before the page.  A directory is built once per
order: the rows are range-partitioned and sorted by the order (which must be total: end it with a
key), written partition by partition, and a small table says for each partition how many rows
it and those before it have, and its first key.  Page N then reads only the partitions that hold its
rows: by the running sizes, in a handful of rows of the directory, whatever N is.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from marquee.plans.paging import page_window
from marquee.session import scratch_dir

PART, PLACE = "_part", "_place"


def sort_columns(order: list[str]) -> list[Column]:
    """Order columns by name, with - before those that go down."""
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def build(df: DataFrame, order: list[str], root: str | None = None, partitions: int | None = None) -> str:
    """Write the rows in ``order`` with their directory; returns the folder."""
    spark = df.sparkSession
    root = root or scratch_dir(spark, "pages")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = sort_columns(order)
    ranged = df.repartitionByRange(n, *keys).withColumn(PART, F.spark_partition_id()).sortWithinPartitions(*keys)
    ranged.write.partitionBy(PART).parquet(os.path.join(root, "rows"))
    df.limit(0).write.parquet(os.path.join(root, "schema"))  # an empty table has no partition to take it from
    rows = _rows(spark, root)
    first = F.min_by(F.struct(*[F.col(c.lstrip("-")) for c in order]), PLACE).alias("first_key")
    placed = rows.withColumn(PLACE, F.row_number().over(Window.partitionBy(PART).orderBy(*keys)))
    sizes = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("size"), first)
    before = F.coalesce(F.sum("size").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition
    sizes.select(PART, "size", before.alias("before"), "first_key").coalesce(1).write.parquet(os.path.join(root, "directory"))
    return root


def _rows(spark: SparkSession, root: str) -> DataFrame:
    schema = spark.read.parquet(os.path.join(root, "schema")).schema.add(PART, IntegerType())
    return spark.read.schema(schema).parquet(os.path.join(root, "rows"))


def directory(spark: SparkSession, root: str) -> DataFrame:
    """(_part, size, before, first_key) of every partition with rows."""
    return spark.read.parquet(os.path.join(root, "directory"))


def _held(spark: SparkSession, root: str, condition: Column) -> list:
    return directory(spark, root).filter(condition).select(PART, "before").orderBy(PART).collect()  # the partitions of one page


def page(spark: SparkSession, root: str, order: list[str], page=None, limit=None) -> DataFrame:
    """Page ``page`` (from 1) of ``limit`` rows (10, at most 50), in order; past the end it is empty."""
    offset, n = page_window(page, limit)
    rows = _rows(spark, root)
    held = _held(spark, root, (F.col("before") < offset + n) & (F.col("before") + F.col("size") > offset))
    if not held:
        return rows.drop(PART).limit(0)
    mine = rows.filter(F.col(PART).isin([r[PART] for r in held])).drop(PART)  # partition pruning: no other file is opened
    return mine.orderBy(*sort_columns(order)).offset(offset - held[0]["before"]).limit(n)
