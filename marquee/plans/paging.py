"""Paging (O10): page >= 1, limit defaults to 10 and is capped at 50.

``paged`` is offset paging: Spark plans sort + offset + limit as a top-(offset +
limit) per task, so it stays cheap for shallow pages.  For deep pages use
``paged_after`` (keyset): filter past the last key seen, then take the top
``limit``; the filter reaches the scan and the work no longer grows with depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LIMIT, DEFAULT_LIMIT = 50, 10  # fixed values of the reference's helper


def page_window(page=None, limit=None) -> tuple[int, int]:
    try:
        p = max(1, int(page or 1))
    except (TypeError, ValueError):
        p = 1
    try:
        n = int(limit or 0) or DEFAULT_LIMIT
    except (TypeError, ValueError):
        n = DEFAULT_LIMIT
    n = min(MAX_LIMIT, n)
    return (p - 1) * n, n


def paged(df: DataFrame, order: list[Column], page=None, limit=None) -> DataFrame:
    offset, n = page_window(page, limit)
    return df.orderBy(*order).offset(offset).limit(n)


def paged_after(df: DataFrame, order_cols: list[str], after: tuple | None, limit=None, descending: bool = False) -> DataFrame:
    """Keyset page: rows strictly after ``after`` in (order_cols) order (all asc or all desc)."""
    _, n = page_window(1, limit)
    out = df
    if after is not None:
        # lexicographic "after": (k1 > v1) or (k1 = v1 and k2 > v2) or ...; a plain
        # predicate on the key columns, so it can reach the scan
        pred, prefix = None, None
        for c, v in zip(order_cols, after):
            lit = F.lit(v).cast(df.schema[c].dataType)
            step = (F.col(c) < lit) if descending else (F.col(c) > lit)
            term = step if prefix is None else prefix & step
            pred = term if pred is None else pred | term
            eq = F.col(c) == lit
            prefix = eq if prefix is None else prefix & eq
        out = out.filter(pred)
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    return out.orderBy(*order).limit(n)
