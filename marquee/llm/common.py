"""Reading tables, shipping the package to executors, task-side Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import marquee
from marquee.plans.lineage import materialize
from marquee.plans.paths import remove

__all__ = ["materialize", "read", "ship", "over", "over_parts", "columns_as", "discard", "written"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Give executors the package, once per application: their machines need no copy of it."""
    sc = spark.sparkContext
    if getattr(sc, "_marquee_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(marquee.__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "marquee_lib.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("marquee", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._marquee_shipped = True


def written(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` after which the shuffle files behind ``df`` may go: Spark's cleaner drops them once
    the driver's garbage is collected, which a job of many steps would else wait long for."""
    out = materialize(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that a later written table has replaced: their files would lie in the shared folder till the end."""
    for table in tables:
        for folder in sorted({os.path.dirname(f) for f in table.inputFiles()}):
            remove(table.sparkSession, folder)


def columns_as(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under internal names: other columns of the input can't clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def over(df: DataFrame, task: Callable[[pa.RecordBatch], Iterator[list]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function from one batch to column lists in the order of ``schema``."""
    def each(batches):
        for batch in batches:
            yield from task(batch)

    return over_parts(df, each, schema)


def over_parts(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: str) -> DataFrame:
    """``over`` for a function from all batches of a partition."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    kinds = arrow_schema(df.sparkSession, schema)

    def run(batches):
        try:
            for cols in task(batches):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                                  for c, f in zip(cols, kinds, strict=True)], schema=kinds)
        finally:
            release()

    return df.mapInArrow(run, schema)


_KEPT: list = [None, None]


def kept(name: str, key, build: Callable):
    """A worker's model of one operator, built once; the model of the operator that ran before goes."""
    if _KEPT[0] != (name, key):
        _KEPT[:] = [None, None]
        _KEPT[:] = [(name, key), build()]
    return _KEPT[1]


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches of at most ``size`` bytes, where the session does not say otherwise: tasks
    hold a batch and its results, however long the texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, str(size))


def release() -> None:
    """Give a task's memory back: Spark's Python workers are used again and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
