"""Request field rules (P13), as ``errors`` arrays computed by JVM expressions.

Each kind lists (message, failing condition) pairs; the result keeps every
request, adds ``errors`` (in rule order) and ``valid``; ``split_valid`` gives
the two sides.  Messages are the reference's validator texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.apply import EMAIL_RE, MIN_PASSWORD


def _blank(c: str) -> F.Column:
    return F.coalesce(F.length(F.trim(F.col(c).cast("string"))), F.lit(0)) == 0


def _not_int_at_least(c: str, lo: int) -> F.Column:
    return ~F.coalesce(F.col(c).cast("string").try_cast("bigint") >= lo, F.lit(False))


# The reference's validation messages, per request kind.
RULES = {
    "register": [
        ("Name is required", lambda: _blank("full_name")),
        ("Valid email is required", lambda: ~F.coalesce(F.col("email").rlike(EMAIL_RE), F.lit(False))),
        ("Password must be at least 6 characters", lambda: ~F.coalesce(F.col("password_length") >= MIN_PASSWORD, F.lit(False))),
    ],
    "booking": [
        ("event_id must be a positive integer", lambda: _not_int_at_least("show_id", 1)),
        ("seat_ids must be a non-empty array", lambda: F.coalesce(F.size("seat_ids"), F.lit(0)) < 1),
        ("Each seat_id must be a positive integer",
         lambda: F.coalesce(F.exists("seat_ids", lambda s: s.isNull() | (s < 1)), F.lit(False))),
    ],
    "show": [
        ("Title is required", lambda: _blank("title")),
        ("Valid date required", lambda: F.col("show_date").cast("string").try_cast("date").isNull()),
        ("Time is required", lambda: _blank("show_time")),
        ("venue_id required", lambda: F.col("venue_id").cast("string").try_cast("bigint").isNull()),
        ("category_id required", lambda: F.col("category_id").cast("string").try_cast("bigint").isNull()),
        ("base_price required", lambda: ~F.coalesce(F.col("base_price").cast("string").try_cast("double") >= 0, F.lit(False))),
    ],
    "review": [
        ("event_id is required", lambda: _not_int_at_least("show_id", 1)),
        ("Rating must be 1–5", lambda: ~F.coalesce(F.col("rating").cast("string").try_cast("int").between(1, 5), F.lit(False))),
    ],
    "payment": [
        ("payment_status must be SUCCESS or FAILED",
         lambda: ~F.coalesce(F.col("payment_status").isin("SUCCESS", "FAILED"), F.lit(False))),
    ],
    "food": [
        ("food_name and price are required", lambda: _blank("food_name") | F.col("price").isNull()),
    ],
}


def validate_requests(df: DataFrame, kind: str) -> DataFrame:
    checks = [F.when(cond(), F.lit(msg)) for msg, cond in RULES[kind]]
    return (df.withColumn("errors", F.array_compact(F.array(*checks)))
              .withColumn("valid", F.size("errors") == 0))


def split_valid(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    v = validate_requests(df, kind)
    return v.filter("valid").drop("errors", "valid"), v.filter(~F.col("valid"))
