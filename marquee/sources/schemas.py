"""Explicit schemas of the eleven booking tables and of the request tables."""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S = T.LongType(), T.IntegerType(), T.StringType()
B, D, TS = T.BooleanType(), T.DateType(), T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)
FOOD_MONEY = T.DecimalType(8, 2)
RATING = T.DecimalType(3, 2)
# outputs that sum money are emitted as decimal(18,2) on both the Spark and oracle side
SUM_MONEY = T.DecimalType(18, 2)


def _st(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


TABLES = {
    "categories": _st(("category_id", L, False), ("category_name", S, False), ("description", S, True)),
    "venues": _st(("venue_id", L, False), ("venue_name", S, False), ("city", S, False),
                  ("state", S, False), ("capacity", I, False), ("address", S, False)),
    "users": _st(("user_id", L, False), ("full_name", S, False), ("email", S, False),
                 ("password_hash", S, False), ("is_admin", B, False), ("created_at", TS, False)),
    "shows": _st(("show_id", L, False), ("title", S, False), ("description", S, True),
                 ("show_date", D, False), ("show_time", S, False), ("venue_id", L, False),
                 ("category_id", L, False), ("base_price", MONEY, False), ("avg_rating", RATING, False)),
    "seats": _st(("seat_id", L, False), ("show_id", L, False), ("row_letter", S, False),
                 ("seat_number", I, False), ("seat_type", S, False), ("is_available", I, False),
                 ("price", MONEY, False)),
    "bookings": _st(("booking_id", L, False), ("user_id", L, False), ("show_id", L, False),
                    ("booking_date", TS, False), ("total_amount", MONEY, False),
                    ("booking_status", S, False), ("reminder_sent", I, False)),
    "booking_seats": _st(("bs_id", L, False), ("booking_id", L, False), ("seat_id", L, False)),
    "food_items": _st(("food_id", L, False), ("food_name", S, False), ("price", FOOD_MONEY, False),
                      ("is_veg", I, False)),
    "booking_food": _st(("bf_id", L, False), ("booking_id", L, False), ("food_id", L, False),
                        ("quantity", I, False)),
    "payments": _st(("payment_id", L, False), ("booking_id", L, False), ("amount", MONEY, False),
                    ("payment_method", S, False), ("payment_status", S, False), ("paid_at", TS, True)),
    "reviews": _st(("review_id", L, False), ("user_id", L, False), ("show_id", L, False),
                   ("rating", I, False), ("comment", S, True), ("reviewed_at", TS, False)),
}

FOOD_LINE = T.StructType([T.StructField("food_id", L), T.StructField("quantity", I)])

REQUESTS = {
    "booking": _st(("request_id", L, False), ("requested_at", TS, False), ("user_id", L, False),
                   ("show_id", L, False), ("seat_ids", T.ArrayType(L), True),
                   ("food", T.ArrayType(FOOD_LINE), True), ("payment_method", S, True)),
    "cancel": _st(("request_id", L, False), ("requested_at", TS, False), ("booking_id", L, False),
                  ("actor_id", L, False), ("actor_is_admin", B, False)),
    "payment": _st(("request_id", L, False), ("requested_at", TS, False), ("booking_id", L, False),
                   ("actor_id", L, False), ("actor_is_admin", B, False),
                   ("payment_status", S, True), ("payment_method", S, True)),
    "review": _st(("request_id", L, False), ("requested_at", TS, False), ("user_id", L, False),
                  ("show_id", L, False), ("rating", I, True), ("comment", S, True)),
    "registration": _st(("request_id", L, False), ("requested_at", TS, False),
                        ("full_name", S, True), ("email", S, True)),
    "seat_map": _st(("show_id", L, False), ("n_rows", I, True), ("seats_per_row", I, True),
                    ("vip_rows", I, True), ("premium_rows", I, True), ("vip_price", MONEY, True),
                    ("premium_price", MONEY, True), ("regular_price", MONEY, True)),
    "show_patch": _st(("request_id", L, False), ("requested_at", TS, False), ("show_id", L, False),
                      ("patch", T.MapType(S, S), True)),
}

# Fixed values that must equal the reference's (domains of its ENUM columns).
SEAT_TYPES = ["VIP", "PREMIUM", "REGULAR"]
BOOKING_STATUSES = ["CONFIRMED", "CANCELLED", "PENDING"]
PAYMENT_STATUSES = ["PENDING", "SUCCESS", "FAILED"]



def conform(df, name: str):
    """Select and cast ``df`` to the declared table schema (column order too)."""
    schema = TABLES[name]
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
