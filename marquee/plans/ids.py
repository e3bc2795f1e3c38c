"""Dense id assignment without a single-partition window.

``new id = max(existing id) + position of the request in (requested_at, request_id)
order``.  A plain ``row_number() over (order by ...)`` pulls every row into one
task; instead the requests are range-partitioned on the order key, materialised
(so the sampled range bounds are fixed), numbered within each partition, and
shifted by the running total of the partition sizes (one row per partition).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.plans.lineage import materialize


def assign_ids(df: DataFrame, order: list[str], start: Column | int, name: str,
               partitions: int | None = None) -> DataFrame:
    """Add ``name`` = start + 1, start + 2, ... in ``order``; ``start`` may be a scalar subquery column."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ids")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the window below runs over n rows, not over the data
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_p").orderBy(*order)
    start_col = start if isinstance(start, Column) else F.lit(start)
    return (ranged.withColumn("_rn", F.row_number().over(within))
            .join(F.broadcast(offsets), "_p")  # n rows, bounded by the partition count
            .withColumn(name, (start_col + F.col("_off") + F.col("_rn")).cast("long"))
            .drop("_p", "_off", "_rn"))
