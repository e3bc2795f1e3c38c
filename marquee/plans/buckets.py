"""Versioned tables in hash buckets: a new version writes only the buckets that it touches.

A table is dealt by the hash of its key into a fixed number of buckets.  Version n
holds, under ``data/v<n>``, the buckets that it touched, each a folder of Parquet
files; ``pointers/v<n>`` says for every bucket which version holds it now.  Readers
follow one finished pointer, so they never see half a version, and a version that is
written again from the same input replaces itself.  Reading a few buckets opens
only their files.

The driver sees at most one row per bucket (a fixed number), never rows of the table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.plans.paths import exists, latest_version, remove

BUCKET = "_bucket"
NOWHERE = -1  # the version of an empty bucket


class BucketTable:
    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root, schema, keys, buckets

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _data(self, version: int, bucket: int | None = None) -> str:
        path = os.path.join(self.root, "data", f"v{version}")
        return path if bucket is None else os.path.join(path, f"{BUCKET}={bucket}")

    def latest(self, before: int | None = None) -> int | None:
        """The last finished version (smaller than ``before``)."""
        return latest_version(self.spark, os.path.join(self.root, "pointers"), before)

    def pointer(self, version: int | None) -> dict[int, int]:
        """bucket -> version that holds it."""
        if version is None:
            return {}
        rows = self.spark.read.schema("bucket int, version int").parquet(os.path.join(self.root, "pointers", f"v{version}"))
        return {r.bucket: r.version for r in rows.collect()}  # a row per bucket

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of ``rows`` (which have the key columns)."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def read(self, version: int | None, buckets: list[int] | None = None) -> DataFrame:
        """The table as of ``version`` (None: empty), or only some buckets of it."""
        where = self.pointer(version)
        paths = [self._data(v, b) for b, v in sorted(where.items()) if v != NOWHERE and (buckets is None or b in set(buckets))]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame, version: int, buckets: list[int] | None = None, base: int | None = None) -> None:
        """Version ``version``: ``rows`` are the new contents of ``buckets`` (None: all); others stay as in version ``base``."""
        named = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        dealt = rows.select(*named, self.bucket().alias(BUCKET)).repartition(BUCKET)
        dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(self._data(version))
        now = self.pointer(base)
        for b in range(self.buckets) if buckets is None else buckets:
            now[b] = version if exists(self.spark, self._data(version, b)) else NOWHERE
        pointer = self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1)
        pointer.write.mode("overwrite").parquet(os.path.join(self.root, "pointers", f"v{version}"))

    def forget(self, version: int) -> None:
        """Drop the bucket folders that only versions before ``version`` use."""
        kept = set(self.pointer(version).items())
        old = self.latest(version)
        while old is not None:
            for b, v in self.pointer(old).items():
                if v != NOWHERE and (b, v) not in kept:
                    remove(self.spark, self._data(v, b))
            remove(self.spark, os.path.join(self.root, "pointers", f"v{old}"))
            old = self.latest(version)
