"""Vectors as rows of exact whole numbers: which take part, how they travel, exact inner products.

A component x becomes floor(scale x), computed in double, which is a whole number that a
double holds exactly; rows travel as little-endian doubles.  Inner products are exact
whole numbers: by float where every partial sum fits in 53 bits, else in 64-bit integers where those
fit, else in Python integers.  A product outside the range of a long counts as that range's end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import over, written

LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(df: DataFrame, scale: int, key: str = "vec_id", more: tuple[str, ...] = ()) -> DataFrame:
    """key (long), ``more`` and v (array of double) of the rows that take part.

    Null keys, null vectors, null components and components that are not finite (also after scaling)
    take no part.  Of rows with one key the smallest (by ``more``, then vector) stands for all."""
    scaled = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < float("inf")))
    # floor() yields a long: parts beyond 2**53 are whole numbers as they are
    whole = F.transform("v", lambda x: F.when(F.abs(x.cast("double") * scale) < 2.0**53, F.floor(x.cast("double") * scale).cast("double")).otherwise(x.cast("double") * scale))
    rows = df.where(F.col(key).isNotNull() & F.col("v").isNotNull()).where(scaled).select(F.col(key).cast("long").alias(key), *more, whole.alias("v"))
    again = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    again = written(again, "vectors-again")
    if again.isEmpty():
        return rows
    one = rows.join(again, key, "left_semi").groupBy(key).agg(F.min(F.struct(*more, "v")).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in (*more, "v")])
    return rows.join(again, key, "left_anti").unionByName(one)


def packed(rows: DataFrame, schema: str) -> DataFrame:
    """Rows whose last column is v -> the same with ``row`` (binary) and ``width`` in its place; ``schema`` names the others."""
    def task(batch):
        v = batch.column(batch.num_columns - 1)
        flat = v.flatten().to_numpy(zero_copy_only=False).astype("<f8")
        ends = np.concatenate([[0], np.cumsum(np.diff(v.offsets.to_numpy()))])
        yield [*batch.columns[:-1], pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()), np.diff(ends).astype(np.int32)]

    return over(rows, task, f"{schema}, row binary, width int")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


def top(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, as int64 (cut to its range)."""
    most = top(a) * top(b) * (a.shape[1] + 1)  # Python integers: no overflow
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    big = [[int(x) for x in r] for r in b.tolist()]
    return np.array([[min(HIGH, max(LOW, sum(x * y for x, y in zip(r, c)))) for c in big] for r in ([int(x) for x in r] for r in a.tolist())], np.int64).reshape(len(a), len(b))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
