"""Booking documents, lines, payments, reviews and visibility
(J5, J6, J8-J13, J17-J21, A10-A12, P5, P6, P9, P12, S5).

Nested outputs are built from sides pre-aggregated to one row per booking
(``collect_list`` of seat structs, of food structs), joined after the fact:
joining seat lines and food lines first and aggregating later would multiply
rows (seats x food per booking).  A booking's lines are bounded by its seats,
so no collected group grows with the table.
"""

from __future__ import annotations

from copy import copy
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marquee.functions.numeric import money
from marquee.functions.text import seat_labels_agg
from marquee.operators.allocate import asked_marks, is_marked, seats_asked
from marquee.plans.lineage import brief_shuffles, materialize
from marquee.plans.paths import remove
from marquee.session import scratch_dir

SENT_BLOCKS = 200_000  # blocks of seat ids (two longs each) that may be sent to every executor
SLICES, SLICE = 8, 250_000  # slices in which documents are made, at most; bookings of a slice, at least


def booking_seat_lines(st: dict) -> DataFrame:
    """booking_seats joined to seats.

    Lines are far fewer than seats: each task hashes its lines and passes the seats by them, so the seats are never
    sorted.  The hint on the seats (one that yields to the lines' hint) takes the place of a merge hint they may carry."""
    return st["booking_seats"].hint("shuffle_hash").join(st["seats"].hint("shuffle_replicate_nl"), "seat_id") \
        .select("booking_id", "seat_id", "show_id", "row_letter", "seat_number", "seat_type", "price")


def _blocks(rows: DataFrame) -> DataFrame:
    """(block, bits): the seat ids of ``rows`` as bits of blocks of 64 ids; a task reduces its own before they are sent."""
    bit = F.expr("shiftleft(1L, cast(seat_id & 63 as int))")
    return rows.filter("seat_id is not null").groupBy(F.shiftright("seat_id", 6).alias("block")).agg(F.bit_or(bit).alias("bits"))


def held_seats(st: dict) -> DataFrame:
    """The rows of ``seats`` that a seat line names, and few others: what ``booking_seat_lines`` needs of them.

    Seats are far more than lines, so they stay where their shows are: a line's seat is looked for in its booking's show.
    The other seats' ids meet the lines' ids as bits of blocks of 64; those that lines name all the same are added."""
    lines = st["booking_seats"].select("booking_id", "seat_id")
    asked = lines.join(st["bookings"].select("booking_id", "show_id"), "booking_id").select("show_id", "seat_id")
    near = seats_asked(st["seats"], asked)
    others = (st["seats"].hint("shuffle_replicate_nl").join(asked_marks(asked).hint("shuffle_hash"), "show_id", "left")
              .filter(~F.coalesce(is_marked(), F.lit(False))).drop("_marks"))
    named = _blocks(others).join(_blocks(lines).withColumnRenamed("bits", "_named"), "block")
    far = materialize(named.select("block", F.col("bits").bitwiseAND(F.col("_named")).alias("bits")).filter("bits <> 0"), "held-elsewhere")
    if far.isEmpty():
        return near
    few = F.broadcast(far) if far.limit(SENT_BLOCKS + 1).count() <= SENT_BLOCKS else far.hint("shuffle_hash")
    there = others.hint("shuffle_replicate_nl").withColumn("block", F.shiftright("seat_id", 6)).join(few, "block")
    return near.unionByName(there.filter("shiftright(bits, cast(seat_id & 63 as int)) & 1 = 1").select(*near.columns))


def booking_food_lines(st: dict) -> DataFrame:
    """booking_food joined to the menu, with price x quantity."""
    return (st["booking_food"].join(st["food_items"], "food_id")
            .select("booking_id", "food_id", "food_name", "quantity", "price",
                    money(F.col("price") * F.col("quantity")).alias("subtotal")))


def seats_by_booking(st: dict, lines: DataFrame | None = None) -> DataFrame:
    return ((booking_seat_lines(st) if lines is None else lines).groupBy("booking_id")
            .agg(F.array_sort(F.collect_list(F.struct("row_letter", "seat_number", "seat_id", "seat_type", "price")))
                 .alias("seats"),
                 F.sum("price").alias("_seat_total")))


def food_by_booking(st: dict) -> DataFrame:
    return (booking_food_lines(st).groupBy("booking_id")
            .agg(F.array_sort(F.collect_list(F.struct("food_id", "food_name", "quantity", "price", "subtotal")))
                 .alias("food"),
                 F.sum("subtotal").alias("_food_total")))


def seat_labels(st: dict) -> DataFrame:
    """A10: per booking the GROUP_CONCAT of its seat labels, ordered by (row, number)."""
    return booking_seat_lines(st).groupBy("booking_id").agg(seat_labels_agg().alias("seat_labels"))


def booking_cost(st: dict, ids: DataFrame | None = None) -> DataFrame:
    """fn_total_booking_cost (A12): seat total + sum(price x quantity); none => 0;
    an unknown id => 0.  Two pre-aggregates joined to the ids, never join-then-sum."""
    seat_t = booking_seat_lines(st).groupBy("booking_id").agg(F.sum("price").alias("_s"))
    food_t = booking_food_lines(st).groupBy("booking_id").agg(F.sum("subtotal").alias("_f"))
    keys = st["bookings"].select("booking_id") if ids is None else ids.select("booking_id").distinct()
    zero = F.lit(Decimal("0.00"))
    return (keys.join(seat_t, "booking_id", "left").join(food_t, "booking_id", "left")
            .select("booking_id", money(F.coalesce("_s", zero)).alias("seat_total"),
                    money(F.coalesce("_f", zero)).alias("food_total"),
                    money(F.coalesce("_s", zero) + F.coalesce("_f", zero)).alias("total_cost")))


def booking_documents(st: dict, bookings: DataFrame | None = None, seat_lines: DataFrame | None = None) -> DataFrame:
    """Bookings with show, venue, (left) payment and nested seats and food.
    Replaces the reference's per-booking query loop with two grouped sides.  ``seat_lines``: ``booking_seat_lines``, if they are made already."""
    b = st["bookings"] if bookings is None else bookings
    pay = st["payments"].select("booking_id", "payment_status", "payment_method", "paid_at")
    shows = st["shows"].select("show_id", "title", "show_date", "show_time", "venue_id").join(st["venues"].select("venue_id", "venue_name", "city"), "venue_id")
    # shows first, while the rows are narrow: documents are not dealt out again for them.  The booking-keyed sides
    # follow: the grouped ones are already hash-partitioned by booking_id, so the three joins share one partitioning
    rows = (b.join(shows.drop("venue_id"), "show_id")
            .join(pay, "booking_id", "left")
            .join(seats_by_booking(st, seat_lines).drop("_seat_total"), "booking_id", "left")
            .join(food_by_booking(st).drop("_food_total"), "booking_id", "left"))
    return rows.select("show_id", "booking_id", *[c for c in b.columns if c not in ("show_id", "booking_id")], "payment_status", "payment_method", "paid_at",
                       "seats", "food", "title", "show_date", "show_time", "venue_name", "city")


def my_bookings(st: dict, user_ids: DataFrame) -> DataFrame:
    """GET /bookings/my (J21, O2): each user's bookings, newest first."""
    b = st["bookings"].join(user_ids.select("user_id").distinct(), "user_id", "left_semi")
    return booking_documents(st, b).orderBy("user_id", F.desc("booking_date"), F.desc("booking_id"))


def booking_detail(st: dict, ids: DataFrame) -> DataFrame:
    """GET /bookings/:id (J21) for a batch of ids."""
    return booking_documents(st, st["bookings"].join(ids.select("booking_id").distinct(), "booking_id", "left_semi"))


def booking_documents_flat(st: dict) -> DataFrame:
    """``booking_documents`` with the arrays rendered as text and counted, comparable across engines."""
    d = booking_documents(st)
    seats_txt = F.array_join(F.transform("seats", lambda s: F.concat(s["row_letter"], s["seat_number"].cast("string"))), " ")
    food_txt = F.array_join(F.transform("food", lambda f: F.concat(f["food_id"].cast("string"), F.lit("x"),
                                                                    f["quantity"].cast("string"))), " ")
    return d.select("booking_id", "user_id", "show_id", "title", "venue_name", "booking_status", "total_amount",
                    "payment_status", F.coalesce(F.size("seats"), F.lit(0)).cast("int").alias("n_seats"),
                    F.coalesce(seats_txt, F.lit("")).alias("seat_list"),
                    F.coalesce(F.size("food"), F.lit(0)).cast("int").alias("n_food"),
                    F.coalesce(food_txt, F.lit("")).alias("food_list"))


def bookings_admin(st: dict) -> DataFrame:
    """Every booking with customer, show and (left) payment, newest first."""
    return (st["bookings"].join(st["users"].select("user_id", "full_name", "email"), "user_id")
            .join(st["shows"].select("show_id", "title"), "show_id")
            .join(st["payments"].select("booking_id", "payment_status", "payment_method"), "booking_id", "left")
            .select("booking_id", "user_id", "full_name", "email", "show_id", "title", "booking_date",
                    "total_amount", "booking_status", "payment_status", "payment_method")
            .orderBy(F.desc("booking_date"), F.desc("booking_id")))


def ticket_manifest(st: dict, ids: DataFrame | None = None) -> DataFrame:
    """The data of a ticket: booking, show, venue, customer and seats (labels with type)."""
    b = st["bookings"] if ids is None else st["bookings"].join(ids.select("booking_id").distinct(), "booking_id", "left_semi")
    lines = booking_seat_lines(st).groupBy("booking_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("row_letter", "seat_number", "seat_type"))),
            lambda s: F.concat(s["row_letter"], s["seat_number"].cast("string"), F.lit("("), s["seat_type"], F.lit(")"))),
            ", ").alias("seat_list"),
        F.count(F.lit(1)).alias("n_seats"))
    return (b.join(lines, "booking_id")
            .join(st["users"].select("user_id", "full_name", "email"), "user_id")
            .join(st["shows"].select("show_id", "title", "show_date", "show_time", "venue_id"), "show_id")
            .join(st["venues"].select("venue_id", "venue_name", "city"), "venue_id")
            .select("booking_id", "full_name", "email", "title", "show_date", "show_time", "venue_name", "city",
                    "total_amount", "booking_status", "seat_list", F.col("n_seats").cast("long").alias("n_seats")))


def visible_to(st: dict, access: DataFrame) -> DataFrame:
    """A booking is visible to its owner or to an admin; ``access`` rows are
    (booking_id, actor_id, actor_is_admin).  One equi-join on booking_id."""
    return (access.join(st["bookings"].select("booking_id", F.col("user_id").alias("_owner")), "booking_id", "left")
            .select("booking_id", "actor_id", "actor_is_admin",
                    (F.col("_owner").isNotNull() & ((F.col("_owner") == F.col("actor_id")) | F.col("actor_is_admin")))
                    .alias("visible")))


def user_profile(st: dict, ids: DataFrame | None = None) -> DataFrame:
    """The profile without the password hash."""
    u = st["users"] if ids is None else st["users"].join(ids.select("user_id").distinct(), "user_id", "left_semi")
    return u.select("user_id", "full_name", "email", "is_admin", "created_at")


def payments_by_status(st: dict, status: str | None = None) -> DataFrame:
    """P5: payments, optionally of one status (pushed down to the scan)."""
    p = st["payments"]
    return p if status in (None, "") else p.filter(F.col("payment_status") == status)


def payments_admin(st: dict, status: str | None = None) -> DataFrame:
    """Payments with booking, customer and show; newest payment first, NULLs last."""
    return (payments_by_status(st, status)
            .join(st["bookings"].select("booking_id", "user_id", "show_id", "booking_status"), "booking_id")
            .join(st["users"].select("user_id", "full_name", "email"), "user_id")
            .join(st["shows"].select("show_id", F.col("title").alias("event_title")), "show_id")
            .select("payment_id", "booking_id", "amount", "payment_method", "payment_status", "paid_at",
                    "booking_status", "full_name", "email", "event_title")
            .orderBy(F.desc_nulls_last("paid_at"), F.desc("payment_id")))


def payment_detail(st: dict, access: DataFrame) -> DataFrame:
    """J13 + P9: the payment of each requested booking with owner, status and show
    title, plus whether the asking actor may see it.  ``access`` has
    (booking_id, actor_id, actor_is_admin); unknown bookings drop out (404)."""
    return (access.join(st["payments"], "booking_id")
            .join(st["bookings"].select("booking_id", "user_id", "booking_status", "show_id"), "booking_id")
            .join(st["shows"].select("show_id", F.col("title").alias("event_title")), "show_id")
            .select("booking_id", "actor_id", "payment_id", "amount", "payment_method", "payment_status", "paid_at",
                    "user_id", "booking_status", "event_title",
                    ((F.col("user_id") == F.col("actor_id")) | F.col("actor_is_admin")).alias("visible")))


def food_menu(st: dict, veg_only="false") -> DataFrame:
    """The menu by name; only vegetarian items when veg_only is the exact string 'true'."""
    f = st["food_items"]
    if veg_only == "true":
        f = f.filter(F.col("is_veg") == 1)
    return f.orderBy("food_name", "food_id")


def has_booked(st: dict, pairs: DataFrame) -> DataFrame:
    """Does (user, show) have a CONFIRMED booking; a semi-join flag, no LIMIT 1."""
    conf = (st["bookings"].filter(F.col("booking_status") == "CONFIRMED")
            .select("user_id", "show_id").distinct().withColumn("has_booked", F.lit(True)))
    return (pairs.select("user_id", "show_id").distinct().join(conf, ["user_id", "show_id"], "left")
            .withColumn("has_booked", F.coalesce("has_booked", F.lit(False))))


def has_reviewed(st: dict, pairs: DataFrame) -> DataFrame:
    """Does (user, show) have a review, and which (the earliest id if several)."""
    r = (st["reviews"].groupBy("user_id", "show_id")
         .agg(F.min(F.struct("review_id", "rating", "comment")).alias("review")))
    return (pairs.select("user_id", "show_id").distinct().join(r, ["user_id", "show_id"], "left")
            .select("user_id", "show_id", F.col("review").isNotNull().alias("has_reviewed"),
                    F.col("review.review_id").alias("review_id"), F.col("review.rating").alias("rating"),
                    F.col("review.comment").alias("comment")))


def show_reviews(st: dict, show_ids: DataFrame | None = None) -> DataFrame:
    """Reviews with reviewer name per show, newest first, plus the live
    average and count of the show (A8) on every row."""
    from marquee.operators.analytics import avg_rating
    r = st["reviews"]
    if show_ids is not None:
        r = r.join(show_ids.select("show_id").distinct(), "show_id", "left_semi")
    live = avg_rating(st, show_ids).withColumnRenamed("avg_rating", "live_avg_rating")
    return (r.join(st["users"].select("user_id", "full_name"), "user_id")
            .join(live, "show_id")
            .select("review_id", "show_id", "user_id", "full_name", "rating", "comment", "reviewed_at",
                    "live_avg_rating", "review_count")
            .orderBy("show_id", F.desc("reviewed_at"), F.desc("review_id")))


def my_reviews(st: dict, user_ids: DataFrame | None = None) -> DataFrame:
    """Each user's reviews with show and venue, newest first."""
    r = st["reviews"]
    if user_ids is not None:
        r = r.join(user_ids.select("user_id").distinct(), "user_id", "left_semi")
    return (r.join(st["shows"].select("show_id", "title", "show_date", "venue_id"), "show_id")
            .join(st["venues"].select("venue_id", "venue_name", "city"), "venue_id")
            .select("review_id", "user_id", "show_id", "title", "show_date", "venue_name", "city", "rating",
                    "comment", "reviewed_at")
            .orderBy("user_id", F.desc("reviewed_at"), F.desc("review_id")))


def seat_detail(st: dict, seat_ids: DataFrame | None = None) -> DataFrame:
    """A seat with its show title."""
    s = st["seats"] if seat_ids is None else st["seats"].join(seat_ids.select("seat_id").distinct(), "seat_id", "left_semi")
    return s.join(st["shows"].select("show_id", F.col("title").alias("event_title")), "show_id")


def doc_sink(df: DataFrame, path: str, key: str | None = None) -> DataFrame:
    """Write rows as JSON documents (one per line, nested columns intact, files packed by gzip); returns
    the per-key document count that the API put in its ``count`` field."""
    spark = df.sparkSession
    with brief_shuffles(spark):
        df.write.mode("overwrite").json(path, compression="gzip")
    return counted_documents(spark, df.schema, path, key)


def counted_documents(spark: SparkSession, schema: StructType, path: str, key: str | None = None) -> DataFrame:
    back = spark.read.schema(schema).json(path)
    return back.groupBy(key).count() if key else back.agg(F.count(F.lit(1)).alias("count"))


def sink_booking_documents(st: dict, path: str) -> DataFrame:
    """S5 over every booking's document: (user_id, count).

    Only seats that seat lines name are moved.  The booking-keyed tables are written once, dealt by a hash of the booking
    id into at most ``SLICES`` slices, and the documents are made slice by slice: no more than a slice is shuffled at a time."""
    spark = st["bookings"].sparkSession
    st, root = copy(st), scratch_dir(spark, "document-parts")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}", partitionBy="_slice" if "_slice" in df.columns else None)
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    with brief_shuffles(spark):
        st["shows"] = written(st["shows"].select("show_id", "title", "show_date", "show_time", "venue_id"), "shows")
        n = max(1, min(SLICES, -(-st["bookings"].count() // SLICE)))
        st["booking_seats"] = written(st["booking_seats"].select("booking_id", "seat_id"), "lines")
        st["seats"] = held_seats(st)
        parts = {"seat_lines": booking_seat_lines(st).drop("show_id"), "bookings": st["bookings"],
                 "payments": st["payments"].select("booking_id", "payment_status", "payment_method", "paid_at"),
                 "booking_food": st["booking_food"].select("booking_id", "food_id", "quantity")}
        for name, df in parts.items():
            parts[name] = written(df.withColumn("_slice", F.coalesce(F.pmod(F.xxhash64("booking_id"), F.lit(n)), F.lit(0)).cast("int")), name)
        remove(spark, f"{root}/lines")
        for k in range(n):
            own = copy(st)
            own.update({name: df.filter(F.col("_slice") == k).drop("_slice") for name, df in parts.items()})
            documents = booking_documents(own, seat_lines=own["seat_lines"])
            documents.write.mode("append" if k else "overwrite").json(path, compression="gzip")
    remove(spark, root)
    return counted_documents(spark, documents.schema, path, "user_id")
