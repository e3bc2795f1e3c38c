"""Run registered queries in Spark and their oracle SQL in DuckDB, compare results.

Usage: python tests/oracle_check.py [sf] [name ...]
Compares row count, column names and an order-insensitive hash of the values
(columns sorted by name), like the driver's correctness gate.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v else "∅"
    if isinstance(v, (dt.datetime,)):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{norm(k)}:{norm(x)}" for k, x in sorted(v.items(), key=lambda kv: str(kv[0]))) + "}"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf = argv[1] if len(argv) > 1 else "0.01"
    names = argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as E
    from marquee.session import get_spark
    spark = get_spark("local[8]")
    qs, ors = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or sorted(qs)):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            cols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in ors:
            print(f"{name:32s} rows={len(srows)} (no oracle) spark={t1 - t0:.1f}s")
            continue
        try:
            res = con.execute(ors[name])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} DUCK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        t2 = time.time()
        hs, ls = digest(cols, srows)
        ho, lo = digest(ocols, orows)
        ok = sorted(cols) == sorted(ocols) and len(srows) == len(orows) and hs == ho
        bad += not ok
        print(f"{name:32s} {'OK ' if ok else 'BAD'} rows={len(srows)}/{len(orows)} "
              f"spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s")
        if not ok:
            if sorted(cols) != sorted(ocols):
                print("   cols spark:", sorted(cols), "\n   cols duck: ", sorted(ocols))
            ds, do = set(ls) - set(lo), set(lo) - set(ls)
            print("   spark-only:", sorted(ds)[:3])
            print("   duck-only: ", sorted(do)[:3])
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
