"""Catalog scans, show listings, lookups, seat summaries and the three views
(S1, S3, S4, P1-P4, P7, P8, J1-J3, A1-A3, O1, O8).

Seats are the largest table (hundreds of rows per show), so every show-level
answer aggregates seats by ``show_id`` first and joins the one-row-per-show
result: no 1:N fan-out before the aggregate, and the partial aggregate runs
map-side.  Venues and categories are small dimensions; Spark's size-checked
join selection (autoBroadcastJoinThreshold, AQE) decides whether to broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def categories_list(st: dict) -> DataFrame:
    return st["categories"].orderBy("category_name", "category_id")


def venues_list(st: dict) -> DataFrame:
    return st["venues"].orderBy("venue_name", "venue_id")


def scan_catalog(st: dict) -> DataFrame:
    """All categories and all venues, each ordered by name, in one long table."""
    cats = st["categories"].select(F.lit("category").alias("kind"), F.col("category_id").alias("item_id"),
                                   F.col("category_name").alias("name"), F.lit(None).cast("string").alias("city"),
                                   F.lit(None).cast("string").alias("state"), F.lit(None).cast("int").alias("capacity"))
    ven = st["venues"].select(F.lit("venue").alias("kind"), F.col("venue_id").alias("item_id"),
                              F.col("venue_name").alias("name"), "city", "state", "capacity")
    return cats.unionByName(ven).orderBy("kind", "name", "item_id")


def seat_counts(seats: DataFrame) -> DataFrame:
    """A1: per show COUNT(seat_id) and SUM(is_available = 1)."""
    return seats.groupBy("show_id").agg(
        F.count("seat_id").alias("total_seats"),
        F.sum(F.when(F.col("is_available") == 1, 1).otherwise(0)).alias("available_seats"))


def show_predicates(category_id=None, city=None, date_from=None, date_to=None, search=None) -> list:
    """One predicate per *supplied* parameter; absent or empty adds none.
    Text tests ignore case like the reference's default collation; the user's %
    and _ stay wildcards (they are not escaped there either)."""
    preds = []
    if category_id not in (None, "", 0):
        preds.append(F.col("category_id") == F.lit(int(category_id)))
    if city not in (None, ""):
        preds.append(F.lower(F.col("city")) == F.lower(F.lit(city)))
    if date_from not in (None, ""):
        preds.append(F.col("show_date") >= F.lit(date_from).cast("date"))
    if date_to not in (None, ""):
        preds.append(F.col("show_date") <= F.lit(date_to).cast("date"))
    if search not in (None, ""):
        preds.append(F.col("title").ilike(f"%{search}%"))
    return preds


def show_listing(st: dict, category_id=None, city=None, date_from=None, date_to=None,
                 search=None) -> DataFrame:
    """GET /events (J2, A1, O1): shows with venue and category, total and available
    seats (0/0 for a show without seats), ordered by date, filters optional."""
    preds = show_predicates(category_id, city, date_from, date_to, search)
    base = (st["shows"].join(st["venues"].select("venue_id", "venue_name", "city", "state", "capacity"), "venue_id")
            .join(st["categories"].select("category_id", "category_name"), "category_id"))
    base = reduce(lambda d, p: d.filter(p), preds, base)
    seats = st["seats"].select("seat_id", "show_id", "is_available")
    if preds:
        # aggregate only the seats of the selected shows (semi join first, aggregate after)
        seats = seats.join(base.select("show_id"), "show_id", "left_semi")
    counts = seat_counts(seats)
    return (base.join(counts, "show_id", "left")
            .select("show_id", "title", "description", "show_date", "show_time", "base_price", "avg_rating",
                    "venue_name", "city", "state", "capacity", "category_name",
                    F.coalesce("total_seats", F.lit(0)).cast("long").alias("total_seats"),
                    F.coalesce("available_seats", F.lit(0)).cast("long").alias("available_seats"))
            .orderBy("show_date", "show_id"))


def point_lookup(st: dict, table: str, ids: DataFrame, key: str | None = None) -> DataFrame:
    """P2, batch form: rows of ``table`` whose key is in ``ids`` (a semi join, no
    duplicates from repeated ids).  The user reader never exposes the hash."""
    key = key or {"shows": "show_id", "bookings": "booking_id", "seats": "seat_id", "payments": "booking_id",
                  "reviews": "review_id", "users": "user_id"}[table]
    out = st[table].join(ids.select(key).distinct(), key, "left_semi")
    return out.drop("password_hash") if table == "users" else out


def seats_available(st: dict, requested: DataFrame) -> DataFrame:
    """fn_is_seat_available (P7): requested seat ids left join seats; unknown id => 0."""
    return (requested.join(st["seats"].select("seat_id", "is_available"), "seat_id", "left")
            .withColumn("is_available", F.coalesce("is_available", F.lit(0)).cast("int")))


def seats_of_show_in(st: dict, requested: DataFrame) -> DataFrame:
    """``seat_id IN (...) AND show_id = ?`` for every (request, seat, show) row: an equi-join on both keys."""
    return requested.join(st["seats"].select("seat_id", "show_id", "is_available", "price"),
                          ["seat_id", "show_id"])


def seat_summary(st: dict, show_ids: DataFrame | None = None) -> DataFrame:
    """A2: per (show, seat_type, price) the seat count and available count."""
    seats = st["seats"]
    if show_ids is not None:
        seats = seats.join(show_ids.select("show_id").distinct(), "show_id", "left_semi")
    return seats.groupBy("show_id", "seat_type", "price").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("is_available") == 1, 1).otherwise(0)).cast("long").alias("available"))


def show_detail(st: dict, show_ids: DataFrame | None = None) -> DataFrame:
    """GET /events/:id (J1): show, venue and category columns plus ``seat_summary``
    as an array of structs (A2, sorted by type and price), one row per show."""
    shows = st["shows"]
    if show_ids is not None:
        shows = shows.join(show_ids.select("show_id").distinct(), "show_id", "left_semi")
    summ = (seat_summary(st, show_ids).groupBy("show_id")
            .agg(F.array_sort(F.collect_list(F.struct("seat_type", "price", "total", "available"))).alias("seat_summary")))
    return (shows.join(st["venues"].select("venue_id", "venue_name", "city", "state", "capacity", "address"), "venue_id")
            .join(st["categories"].select("category_id", "category_name",
                                          F.col("description").alias("category_description")), "category_id")
            .join(summ, "show_id", "left")
            .withColumn("seat_summary", F.coalesce("seat_summary", F.array().cast(summ.schema["seat_summary"].dataType))))


def show_detail_flat(st: dict) -> DataFrame:
    """``show_detail`` with the seat summary rendered as text (comparable across engines)."""
    d = show_detail(st)
    txt = F.array_join(F.transform("seat_summary", lambda s: F.concat_ws(
        " ", s["seat_type"], s["price"].cast("string"),
        F.concat(s["available"].cast("string"), F.lit("/"), s["total"].cast("string")))), "; ")
    return d.select("show_id", "title", "show_date", "base_price", "venue_name", "city", "state",
                    "capacity", "address", "category_name", txt.alias("seat_summary"))


def view_available_seats(st: dict) -> DataFrame:
    """vw_available_seats (A3): available seats per (show, type) and the cheapest
    price; sold-out groups vanish.  The filter reaches the scan; the aggregate is
    per (show, type) and the title join happens on the small result."""
    agg = (st["seats"].filter(F.col("is_available") == 1).groupBy("show_id", "seat_type")
           .agg(F.count(F.lit(1)).alias("available_count"), F.min("price").alias("min_price")))
    return agg.join(st["shows"].select("show_id", "title"), "show_id") \
              .select("show_id", "title", "seat_type", "available_count", "min_price")


def view_booking_summary(st: dict) -> DataFrame:
    """vw_booking_summary (J3): bookings with customer, show, venue and (left) payment."""
    return (st["bookings"].join(st["users"].select("user_id", F.col("full_name").alias("customer_name")), "user_id")
            .join(st["shows"].select("show_id", F.col("title").alias("event_name"), "venue_id"), "show_id")
            .join(st["venues"].select("venue_id", "venue_name", "city"), "venue_id")
            .join(st["payments"].select("booking_id", "payment_status", "payment_method"), "booking_id", "left")
            .select("booking_id", "customer_name", "event_name", "venue_name", "city", "booking_date",
                    "total_amount", "booking_status", "payment_status", "payment_method"))


def booking_report(st: dict) -> DataFrame:
    """sp_booking_report (S4): the cursor loop is one join, ordered by booking id."""
    return (st["bookings"].join(st["users"].select("user_id", F.col("full_name").alias("customer")), "user_id")
            .join(st["shows"].select("show_id", F.col("title").alias("event_name")), "show_id")
            .select("booking_id", "customer", "event_name", "total_amount", F.col("booking_status").alias("status"))
            .orderBy("booking_id"))


def create_views(st: dict) -> None:
    """S3: the three named views, for SQL users of the session (``spark.sql("... FROM vw_event_revenue")``)."""
    from marquee.operators.analytics import view_event_revenue

    view_booking_summary(st).createOrReplaceTempView("vw_booking_summary")
    view_available_seats(st).createOrReplaceTempView("vw_available_seats")
    view_event_revenue(st).createOrReplaceTempView("vw_event_revenue")
