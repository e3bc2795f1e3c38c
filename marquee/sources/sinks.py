"""Sinks: versioned state tables, JSON documents (S5) and the outbox.

Parquet cannot update in place, so every apply job's new state is written as a
new version directory (``v{n+1}``) beside the one being read, never over it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from marquee.operators.documents import doc_sink  # noqa: F401  (S5)
from marquee.operators.notices import outbox_sink  # noqa: F401  (S6)


def write_state(st: dict, root: str, version: int, tables: list[str] | None = None) -> str:
    """Write the state tables to ``root/v{version}/{table}``; returns the version path."""
    path = os.path.join(root, f"v{version}")
    for name in tables or sorted(st):
        st[name].write.mode("errorifexists").parquet(os.path.join(path, name))
    return path


def read_state(spark: SparkSession, root: str, version: int, tables: list[str]) -> dict:
    from marquee.sources.schemas import TABLES
    path = os.path.join(root, f"v{version}")
    return {t: spark.read.schema(TABLES[t]).parquet(os.path.join(path, t)) for t in tables}


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
