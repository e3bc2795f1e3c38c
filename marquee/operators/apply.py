"""Set-based apply jobs for the reference's state changes (M2-M9, M11-M14, M18 in seatmap).

Each takes ``(st, requests)`` and returns ``(new_state, outcomes)``; the outcome
is ACCEPTED-like or the rejection reason, decided in the reference's check
order.  Where several requests of a batch touch the same entity, order comes
from ``(requested_at, request_id)`` and "first/last per key" is a partial
aggregate (``min``/``max_by`` of a struct), never a per-key window, so a hot
key costs one partial row per task.  New state is returned as whole new
tables (Parquet has no in-place update); the caller writes version v+1.
"""

from __future__ import annotations

from copy import copy
from decimal import Decimal
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.analytics import avg_rating
from marquee.plans.ids import assign_ids
from marquee.plans.lineage import materialize
from marquee.sources.driver import BookingState
from marquee.sources.schemas import conform

MIN_PASSWORD = 6  # fixed value: the reference's registration rule
EMAIL_RE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
SHOW_FIELDS = {  # patchable columns -> type (fixed list of the reference's update handler)
    "title": "string", "description": "string", "show_date": "date", "show_time": "string",
    "venue_id": "bigint", "category_id": "bigint", "base_price": "decimal(10,2)",
}


def _order_key() -> F.Column:
    return F.struct(F.col("requested_at").alias("t"), F.col("request_id").alias("i"))


def _may() -> F.Column:
    """The actor owns the row or is an admin; an unknown (NULL) actor is neither."""
    return F.coalesce(F.col("_owner") == F.col("actor_id"), F.lit(False)) | F.coalesce(F.col("actor_is_admin"), F.lit(False))


def _first_per(df: DataFrame, key: list[str], flag: str) -> DataFrame:
    """Mark the earliest row per ``key`` (by requested_at, request_id): partial-aggregate min + join back."""
    firsts = df.groupBy(*key).agg(F.min(_order_key()).alias("_f")).select(F.col("_f.i").alias("request_id"))
    return df.join(firsts.withColumn(flag, F.lit(True)), "request_id", "left") \
             .withColumn(flag, F.coalesce(flag, F.lit(False)))


# --- M2 ----------------------------------------------------------------------
def register_users(st: dict, reqs: DataFrame):
    """Registration (M2): name required, a valid address and a password of at least six
    characters, of which only the length is carried (INVALID); an address
    already registered, or used by an earlier request of the batch, ignoring case
    (DUPLICATE).  New user ids continue the existing ids in arrival order."""
    valid = (F.coalesce(F.length(F.trim("full_name")), F.lit(0)) > 0) & F.coalesce(F.col("email").rlike(EMAIL_RE), F.lit(False))
    if "password_length" in reqs.columns:
        valid = valid & F.coalesce(F.col("password_length") >= MIN_PASSWORD, F.lit(False))
    r = reqs.withColumn("_valid", valid).withColumn("_lemail", F.lower("email"))
    known = st["users"].select(F.lower("email").alias("_lemail")).distinct().withColumn("_known", F.lit(True))
    r = r.join(known, "_lemail", "left")
    cand = r.filter(F.col("_valid") & F.col("_known").isNull())
    cand = _first_per(cand, ["_lemail"], "_first").select("request_id", "_first")
    r = r.join(cand, "request_id", "left")
    out = r.withColumn("outcome", F.when(~F.col("_valid"), "INVALID")
                       .when(F.col("_known") | ~F.col("_first"), "DUPLICATE").otherwise("ACCEPTED"))
    start = st["users"].select(F.coalesce(F.max("user_id"), F.lit(0))).scalar()
    won = assign_ids(out.filter(F.col("outcome") == "ACCEPTED").select("request_id", "requested_at", "full_name", "email"),
                     ["requested_at", "request_id"], start, "user_id")
    outcomes = out.join(won.select("request_id", "user_id"), "request_id", "left") \
                  .select("request_id", "email", "outcome", "user_id")
    new_users = won.select("user_id", "full_name", "email", F.lit("").alias("password_hash"),
                           F.lit(False).alias("is_admin"), F.col("requested_at").alias("created_at"))
    ns = copy(st)
    ns["users"] = conform(st["users"], "users").unionByName(conform(new_users, "users"))
    return ns, outcomes


# --- M3 ----------------------------------------------------------------------
def cancel_bookings(st: dict, reqs: DataFrame):
    """Cancel (M3): unknown booking NOT_FOUND; actor neither owner nor admin
    FORBIDDEN; already cancelled (before the batch, or by an earlier request)
    ALREADY_CANCELLED; else the seat lines, food lines and payment go, the seats
    become free and the booking is CANCELLED (total kept)."""
    b = st["bookings"].select("booking_id", F.col("user_id").alias("_owner"), F.col("booking_status").alias("_status"))
    r = reqs.join(b, "booking_id", "left")
    allowed = r.filter(F.col("_owner").isNotNull() & _may())
    firsts = _first_per(allowed, ["booking_id"], "_first").select("request_id", "_first")
    r = r.join(firsts, "request_id", "left")
    out = r.withColumn("outcome", F.when(F.col("_owner").isNull(), "NOT_FOUND")
                       .when(F.col("_first").isNull(), "FORBIDDEN")
                       .when((F.col("_status") == "CANCELLED") | ~F.col("_first"), "ALREADY_CANCELLED")
                       .otherwise("CANCELLED"))
    outcomes = out.select("request_id", "booking_id", "actor_id", "outcome")
    done = cache(lambda: materialize(out.filter(F.col("outcome") == "CANCELLED").select("booking_id").distinct(), "cancelled"))
    ns = BookingState(st)  # each table is made when first asked for, the cancelled ids once for all of them
    for name in ("booking_seats", "booking_food", "payments"):
        ns[name] = lambda name=name: st[name].join(done(), "booking_id", "left_anti")
    ns["bookings"] = lambda: conform(st["bookings"].join(done().withColumn("_c", F.lit(True)), "booking_id", "left").withColumn(
        "booking_status", F.when(F.col("_c"), "CANCELLED").otherwise(F.col("booking_status"))), "bookings")
    ns["seats"] = lambda: free_seats(st["seats"], st["booking_seats"].join(done(), "booking_id", "left_semi").select("seat_id"))
    return ns, outcomes


# --- M4 / M5 -----------------------------------------------------------------
def apply_payment_results(st: dict, reqs: DataFrame):
    """Gateway results (M4): status must be SUCCESS or FAILED (INVALID_STATUS); no
    payment row NOT_FOUND; actor neither owner nor admin FORBIDDEN.  Applied
    results set the payment status (last one wins), the method (last non-null,
    else the old one), paid_at (the request time on SUCCESS, else NULL) and the
    booking status (CONFIRMED / CANCELLED).  A FAILED result frees the booking's
    seats but keeps its seat lines (M5); a later SUCCESS does not re-claim them."""
    p = st["payments"].select("booking_id", F.lit(True).alias("_has"))
    b = st["bookings"].select("booking_id", F.col("user_id").alias("_owner"))
    r = reqs.join(p, "booking_id", "left").join(b, "booking_id", "left")
    out = r.withColumn("outcome", F.when(~F.coalesce(F.col("payment_status").isin("SUCCESS", "FAILED"), F.lit(False)), "INVALID_STATUS")
                       .when(F.col("_has").isNull(), "NOT_FOUND")
                       .when(_may(), "APPLIED").otherwise("FORBIDDEN"))
    outcomes = out.select("request_id", "booking_id", "actor_id", "payment_status", "outcome",
                          F.when(F.col("outcome") == "APPLIED",
                                 F.when(F.col("payment_status") == "SUCCESS", "CONFIRMED").otherwise("CANCELLED"))
                          .alias("booking_status"))
    applied = out.filter(F.col("outcome") == "APPLIED")
    last = applied.groupBy("booking_id").agg(
        F.max_by(F.struct("payment_status", "requested_at"), _order_key()).alias("_last"),
        F.max_by("payment_method", F.when(F.col("payment_method").isNotNull(), _order_key())).alias("_method"),
        F.max((F.col("payment_status") == "FAILED").cast("int")).alias("_failed"))
    ns = copy(st)
    pay = st["payments"].join(last, "booking_id", "left")
    ns["payments"] = conform(pay.select(
        "payment_id", "booking_id", "amount",
        F.coalesce("_method", "payment_method").alias("payment_method"),
        F.coalesce("_last.payment_status", "payment_status").alias("payment_status"),
        F.when(F.col("_last").isNull(), F.col("paid_at"))
         .when(F.col("_last.payment_status") == "SUCCESS", F.col("_last.requested_at")).alias("paid_at")), "payments")
    bk = st["bookings"].join(last.select("booking_id", "_last"), "booking_id", "left")
    ns["bookings"] = conform(bk.withColumn("booking_status", F.when(F.col("_last").isNull(), F.col("booking_status"))
                                           .when(F.col("_last.payment_status") == "SUCCESS", "CONFIRMED")
                                           .otherwise("CANCELLED")), "bookings")
    failed = last.filter(F.col("_failed") == 1).select("booking_id")
    ns["seats"] = release_failed_seats(st, failed)
    return ns, outcomes


def release_failed_seats(st: dict, failed_bookings: DataFrame) -> DataFrame:
    """Seats of the lines of failed bookings become available; lines stay."""
    return free_seats(st["seats"], st["booking_seats"].join(failed_bookings.select("booking_id").distinct(), "booking_id", "left_semi").select("seat_id"))


def free_seats(seats: DataFrame, freed: DataFrame) -> DataFrame:
    """``seats`` with those of ``freed`` (seat_id, repeats kept) available.

    Seats that are available stay so, freed or not: only the taken ones, a small part, meet the freed ids, and the others
    are neither shuffled nor sorted.  The hint (one that yields to that of the ids) takes the place of a merge hint."""
    free = F.coalesce(F.col("is_available") == 1, F.lit(False))
    ids = freed.distinct().withColumn("_f", F.lit(True))
    taken = seats.filter(~free).hint("shuffle_replicate_nl").join(ids.hint("shuffle_hash"), "seat_id", "left")
    return conform(seats.filter(free), "seats").unionByName(
        conform(taken.withColumn("is_available", F.when(F.col("_f"), 1).otherwise(F.col("is_available"))), "seats"))


# --- M6 / M7 / M8 / M9 ----------------------------------------------------------
def submit_reviews(st: dict, reqs: DataFrame):
    """Reviews (M6): rating 1..5 (INVALID) -> a CONFIRMED booking of the show by the
    user (FORBIDDEN) -> no review of (user, show) before, in state or earlier in
    the batch (DUPLICATE).  An empty comment is stored as NULL."""
    conf = (st["bookings"].filter(F.col("booking_status") == "CONFIRMED").select("user_id", "show_id").distinct()
            .withColumn("_booked", F.lit(True)))
    have = st["reviews"].select("user_id", "show_id").distinct().withColumn("_dup", F.lit(True))
    r = (reqs.withColumn("_rate_ok", F.coalesce(F.col("rating").between(1, 5), F.lit(False)))
         .join(conf, ["user_id", "show_id"], "left").join(have, ["user_id", "show_id"], "left"))
    cand = r.filter(F.col("_rate_ok") & F.col("_booked").isNotNull() & F.col("_dup").isNull())
    cand = _first_per(cand, ["user_id", "show_id"], "_first").select("request_id", "_first")
    out = r.join(cand, "request_id", "left").withColumn(
        "outcome", F.when(~F.col("_rate_ok"), "INVALID").when(F.col("_booked").isNull(), "FORBIDDEN")
        .when(F.col("_dup") | ~F.col("_first"), "DUPLICATE").otherwise("ACCEPTED"))
    start = st["reviews"].select(F.coalesce(F.max("review_id"), F.lit(0))).scalar()
    won = assign_ids(out.filter(F.col("outcome") == "ACCEPTED")
                     .select("request_id", "requested_at", "user_id", "show_id", "rating", "comment"),
                     ["requested_at", "request_id"], start, "review_id")
    outcomes = out.join(won.select("request_id", "review_id"), "request_id", "left") \
                  .select("request_id", "user_id", "show_id", "outcome", "review_id")
    new = won.select("review_id", "user_id", "show_id", "rating",
                     F.when(F.col("comment") == "", F.lit(None)).otherwise(F.col("comment")).alias("comment"),
                     F.col("requested_at").alias("reviewed_at"))
    ns = copy(st)
    ns["reviews"] = conform(st["reviews"], "reviews").unionByName(conform(new, "reviews"))
    ns["shows"] = refresh_avg_rating(ns)
    return ns, outcomes


def update_reviews(st: dict, reqs: DataFrame):
    """PUT /reviews/:id (M7): (request_id, requested_at, review_id, actor_id, rating,
    comment).  Rating 1..5 (INVALID), unknown NOT_FOUND, owner only (FORBIDDEN);
    the last accepted update replaces rating and comment; reviewed_at unchanged."""
    own = st["reviews"].select("review_id", F.col("user_id").alias("_owner"))
    r = reqs.join(own, "review_id", "left")
    out = r.withColumn("outcome", F.when(~F.coalesce(F.col("rating").between(1, 5), F.lit(False)), "INVALID")
                       .when(F.col("_owner").isNull(), "NOT_FOUND")
                       .when(F.coalesce(F.col("_owner") == F.col("actor_id"), F.lit(False)), "UPDATED").otherwise("FORBIDDEN"))
    last = (out.filter(F.col("outcome") == "UPDATED").groupBy("review_id")
            .agg(F.max_by(F.struct("rating", "comment"), _order_key()).alias("_u")))
    ns = copy(st)
    ns["reviews"] = conform(st["reviews"].join(last, "review_id", "left").select(
        "review_id", "user_id", "show_id",
        F.when(F.col("_u").isNull(), F.col("rating")).otherwise(F.col("_u.rating")).alias("rating"),
        F.when(F.col("_u").isNull(), F.col("comment")).otherwise(F.col("_u.comment")).alias("comment"),
        "reviewed_at"), "reviews")
    ns["shows"] = refresh_avg_rating(ns)
    return ns, out.select("request_id", "review_id", "actor_id", "outcome")


def delete_reviews(st: dict, reqs: DataFrame):
    """DELETE /reviews/:id (M8): (request_id, requested_at, review_id, actor_id,
    actor_is_admin).  Unknown NOT_FOUND; owner or admin, else FORBIDDEN; a second
    delete of the same review in the batch is NOT_FOUND."""
    own = st["reviews"].select("review_id", F.col("user_id").alias("_owner"))
    r = reqs.join(own, "review_id", "left")
    allowed = r.filter(F.col("_owner").isNotNull() & _may())
    firsts = _first_per(allowed, ["review_id"], "_first").select("request_id", "_first")
    out = r.join(firsts, "request_id", "left").withColumn(
        "outcome", F.when(F.col("_owner").isNull(), "NOT_FOUND").when(F.col("_first").isNull(), "FORBIDDEN")
        .when(~F.col("_first"), "NOT_FOUND").otherwise("DELETED"))
    gone = out.filter(F.col("outcome") == "DELETED").select("review_id")
    ns = copy(st)
    ns["reviews"] = st["reviews"].join(gone, "review_id", "left_anti")
    # the reference has no trigger on DELETE, so its stored average goes stale; we recompute
    ns["shows"] = refresh_avg_rating(ns)
    return ns, out.select("request_id", "review_id", "actor_id", "outcome")


def refresh_avg_rating(st: dict) -> DataFrame:
    """Every show's avg_rating = rounded live average (0.00 without reviews)."""
    live = avg_rating(st).select("show_id", F.col("avg_rating").alias("_live"))
    return conform(st["shows"].join(live, "show_id", "left")
                   .withColumn("avg_rating", F.coalesce("_live", F.lit(Decimal("0.00")))), "shows")


# --- M11 / M12 / M13 / M14 --------------------------------------------------------
def create_shows(st: dict, reqs: DataFrame):
    """POST /events (M11): title, date, time required, ids given, base_price >= 0
    (INVALID); venue and category must exist (INVALID_REFERENCE, the foreign keys).
    New show ids continue the existing ids in arrival order; avg_rating 0."""
    valid = ((F.coalesce(F.length(F.trim("title")), F.lit(0)) > 0) & F.col("show_date").isNotNull()
             & (F.coalesce(F.length("show_time"), F.lit(0)) > 0) & F.col("venue_id").isNotNull()
             & F.col("category_id").isNotNull() & F.coalesce(F.col("base_price") >= 0, F.lit(False)))
    v = st["venues"].select("venue_id", F.lit(True).alias("_v"))
    c = st["categories"].select("category_id", F.lit(True).alias("_c"))
    r = reqs.withColumn("_ok", valid).join(v, "venue_id", "left").join(c, "category_id", "left")
    out = r.withColumn("outcome", F.when(~F.col("_ok"), "INVALID")
                       .when(F.col("_v").isNull() | F.col("_c").isNull(), "INVALID_REFERENCE").otherwise("CREATED"))
    start = st["shows"].select(F.coalesce(F.max("show_id"), F.lit(0))).scalar()
    won = assign_ids(out.filter(F.col("outcome") == "CREATED").drop("_ok", "_v", "_c", "outcome"),
                     ["requested_at", "request_id"], start, "show_id")
    ns = copy(st)
    ns["shows"] = conform(st["shows"], "shows").unionByName(
        conform(won.withColumn("avg_rating", F.lit(Decimal("0.00"))), "shows"))
    return ns, out.join(won.select("request_id", "show_id"), "request_id", "left").select("request_id", "title", "outcome", "show_id")


def _field_error(field: F.Column, value: F.Column) -> F.Column:
    """What the schema has against a patched value: INVALID (NOT NULL, type, CHECK) or None."""
    bad = F.when(field == "title", value.isNull()).when(field == "description", F.lit(False))
    bad = bad.when(field == "show_time", value.isNull()).when(field == "base_price", ~F.coalesce(value.try_cast(SHOW_FIELDS["base_price"]) >= 0, F.lit(False)))
    for name in ("show_date", "venue_id", "category_id"):
        bad = bad.when(field == name, value.try_cast(SHOW_FIELDS[name]).isNull())
    return F.coalesce(bad, F.lit(False))


def update_shows(st: dict, patches: DataFrame):
    """PUT /events/:id (M12): only fields *present* in the patch change; a patch
    without known fields is NO_FIELDS; an unknown show id is silently UPDATED (the
    UPDATE matches nothing).  A value that the schema refuses makes the whole patch
    fail: INVALID (NULL in a required field, a value of another type, a negative
    price) or INVALID_REFERENCE (no such venue or category).  Several patches of a
    show apply in order: per field the last present value wins."""
    known = F.array(*[F.lit(f) for f in SHOW_FIELDS])
    p = patches.withColumn("_keys", F.array_intersect(F.map_keys("patch"), known))
    exists = st["shows"].select("show_id", F.lit(True).alias("_known"))
    p = p.join(exists, "show_id", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    wrong = F.exists(F.map_entries("patch"), lambda e: _field_error(e["key"], e["value"]))
    p = p.withColumn("_bad", F.col("_known") & F.coalesce(wrong, F.lit(False)))
    for field, table in (("venue_id", "venues"), ("category_id", "categories")):
        ids = st[table].select(F.col(field).alias(f"_{field}"), F.lit(True).alias(f"_has_{field}"))
        p = p.withColumn(f"_{field}", F.col("patch")[field].try_cast("bigint")).join(ids, f"_{field}", "left")
    lost = F.lit(False)
    for field in ("venue_id", "category_id"):
        lost = lost | (F.coalesce(F.map_contains_key("patch", F.lit(field)), F.lit(False)) & F.col(f"_has_{field}").isNull())
    out = p.withColumn("outcome", F.when(F.coalesce(F.size("_keys"), F.lit(0)) < 1, "NO_FIELDS").when(F.col("_bad"), "INVALID")
                       .when(F.col("_known") & lost, "INVALID_REFERENCE").otherwise("UPDATED"))
    entries = (out.filter(F.col("outcome") == "UPDATED")
               .select("show_id", "request_id", "requested_at", F.explode("patch").alias("field", "value"))
               .filter(F.col("field").isin(*SHOW_FIELDS)))
    last = (entries.groupBy("show_id", "field").agg(F.max_by("value", _order_key()).alias("value"))
            .groupBy("show_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_m")))
    s = st["shows"].join(last, "show_id", "left")
    cols = []
    for f in st["shows"].columns:
        if f in SHOW_FIELDS:
            cols.append(F.when(F.coalesce(F.map_contains_key("_m", f), F.lit(False)),
                               F.col("_m")[f].try_cast(SHOW_FIELDS[f])).otherwise(F.col(f)).alias(f))
        else:
            cols.append(F.col(f))
    ns = copy(st)
    ns["shows"] = conform(s.select(*cols), "shows")
    return ns, out.select("request_id", "show_id", "outcome")


def delete_shows(st: dict, reqs: DataFrame):
    """DELETE /events/:id (M13): unknown NOT_FOUND; else the show's reviews, its
    bookings' payments, food lines and seat lines, its bookings, seats and the show
    go (one anti join per table)."""
    ids = reqs.select("request_id", "show_id")
    known = st["shows"].select("show_id", F.lit(True).alias("_k"))
    out = ids.join(known, "show_id", "left").withColumn(
        "outcome", F.when(F.col("_k").isNull(), "NOT_FOUND").otherwise("DELETED")).drop("_k")
    gone = out.filter(F.col("outcome") == "DELETED").select("show_id").distinct()
    gone_b = st["bookings"].join(gone, "show_id", "left_semi").select("booking_id")
    ns = copy(st)
    ns["reviews"] = st["reviews"].join(gone, "show_id", "left_anti")
    ns["payments"] = st["payments"].join(gone_b, "booking_id", "left_anti")
    ns["booking_food"] = st["booking_food"].join(gone_b, "booking_id", "left_anti")
    ns["booking_seats"] = st["booking_seats"].join(gone_b, "booking_id", "left_anti")
    ns["bookings"] = st["bookings"].join(gone, "show_id", "left_anti")
    ns["seats"] = st["seats"].join(gone, "show_id", "left_anti")
    ns["shows"] = st["shows"].join(gone, "show_id", "left_anti")
    return ns, out


def add_food_items(st: dict, reqs: DataFrame):
    """POST /food (M14): name and price required (INVALID); is_veg defaults to 1."""
    ok = (F.coalesce(F.length("food_name"), F.lit(0)) > 0) & F.col("price").isNotNull()
    out = reqs.withColumn("outcome", F.when(ok, "CREATED").otherwise("INVALID"))
    start = st["food_items"].select(F.coalesce(F.max("food_id"), F.lit(0))).scalar()
    won = assign_ids(out.filter(F.col("outcome") == "CREATED"), ["requested_at", "request_id"], start, "food_id")
    new = won.select("food_id", "food_name", "price", F.coalesce("is_veg", F.lit(1)).alias("is_veg"))
    ns = copy(st)
    ns["food_items"] = conform(st["food_items"], "food_items").unionByName(conform(new, "food_items"))
    return ns, out.join(won.select("request_id", "food_id"), "request_id", "left").select(
        "request_id", "food_name", "outcome", "food_id")
