"""Exact half-up rounding on integers.

Spark's ``avg`` of an integer is a double and ``round(8.35, 1)`` of a double can
land on the wrong side; the reference's MySQL ``ROUND(AVG(int), 2)`` is exact
decimal.  So ratios are rounded as ``(2*10^k*num + den) div (2*den)`` and only
then scaled to a decimal.  Everything stays a JVM expression.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Exact floor division of longs: (a - pmod(a, b)) is a multiple of b."""
    a, b = a.cast("long"), b.cast("long")
    return ((a - F.pmod(a, b)).cast("decimal(38,0)") / b.cast("decimal(38,0)")).cast("long")


def half_up_ratio(num: Column, den: Column, scale: int, times: int = 1,
                  precision: int = 18) -> Column:
    """round(times * num / den, scale), half-up, as decimal(precision, scale); null if den is 0."""
    k = 10 ** scale
    n, d = num.cast("long"), den.cast("long")
    units = F.when(d != 0, int_div(F.lit(2 * k * times) * n + d, F.lit(2) * d))
    step = F.lit(Decimal(1).scaleb(-scale)) if scale > 0 else F.lit(Decimal(1))
    return (units.cast(f"decimal({precision},0)") * step).cast(f"decimal({precision},{scale})")


def rating_round(sum_rating: Column, n: Column) -> Column:
    """ROUND(AVG(rating), 2) as decimal(3,2); 0.00 when there are no ratings."""
    return F.coalesce(half_up_ratio(sum_rating, n, 2), F.lit(Decimal("0.00"))).cast("decimal(3,2)")


def money(c: Column) -> Column:
    """Money outputs are decimal(18,2) on both the Spark and the oracle side."""
    return c.cast("decimal(18,2)")
