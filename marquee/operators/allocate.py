"""All-or-nothing seat allocation for batches of booking requests.

Sequential semantics: requests are served in (requested_at, request_id) order;
a request gets all its seats or none, and a rejected request holds nothing.
"First request on each seat wins" is *not* that answer (a request rejected on
seat B does not keep seat A), so allocation runs the parallel greedy fixpoint
for the lexicographically first independent set:

  round: (a) reject undecided requests touching a taken seat;
         (b) accept undecided requests that are the earliest undecided request
             on *every* one of their seats; their seats become taken.

Every round is a handful of shuffles on (request, seat) pairs keyed by seat or
request; the per-seat minimum is a partial aggregate, so a hot seat or a hot
show costs one partial row per task.  A round decides one link of a chain of
conflicts, so after SET_ROUNDS rounds the requests that are still undecided are
labelled by conflict component (rounds grow with the logarithm of the chain);
components of at most TASK_PAIRS pairs are served in order, each within one task,
and larger ones slice by slice of their arrival order, each slice within one task.  All
give the sequential answer, so the limits change no result.
Lineage is cut each round by writing the round's tables as Parquet into the session's
shared checkpoint directory, so a lost executor recomputes at most one round.
"""

from __future__ import annotations

from copy import copy
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.plans.components import components
from marquee.plans.ids import assign_ids
from marquee.plans.lineage import materialize
from marquee.sources.schemas import conform

OUTCOME_ACCEPTED = "ACCEPTED"
OUTCOME_INVALID_REQUEST = "INVALID_REQUEST"
OUTCOME_INVALID_SEAT = "INVALID_SEAT"
OUTCOME_CONFLICT = "CONFLICT"
OUTCOME_INVALID_FOOD = "INVALID_FOOD"
DEFAULT_METHOD = "UPI"
SET_ROUNDS = 3
TASK_PAIRS = 20_000
MARKS = 4096
SENT_IDS = 2_000_000  # seat ids (a long each) that may be sent to every executor
SERVED = "request_id long, requested_at timestamp_ntz, seat_id long"


def _last(table: DataFrame, column: str) -> F.Column:
    """The largest id in use: new ids continue it."""
    return table.select(F.coalesce(F.max(column), F.lit(0))).scalar()


def _mark(col: str) -> F.Column:
    return F.pmod(F.xxhash64(col), F.lit(MARKS)).cast("int")


def asked_marks(asked: DataFrame) -> DataFrame:
    """(show_id, _marks) of ``asked`` (show_id, seat_id)."""
    return asked.groupBy("show_id").agg(F.collect_set(_mark("seat_id")).alias("_marks"))


def is_marked() -> F.Column:
    return F.array_contains("_marks", _mark("seat_id"))


def seats_asked(seats: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``seats`` that may be among ``asked`` (show_id, seat_id), and few others.

    Seats are far more than those asked for: a show's ids asked for, as a set of at most ``MARKS`` hashes, go to where the
    show's seats are, and only seats with such a hash go on to an exact join."""
    # the hint on the seats yields to that of the marks and takes the place of a merge hint they may carry
    near = seats.hint("shuffle_replicate_nl").join(asked_marks(asked).hint("shuffle_hash"), "show_id")
    return near.filter(is_marked()).drop("_marks")


def _seat_pairs(st: dict, reqs: DataFrame, match_show: bool) -> DataFrame:
    """(request, its order key, seat id, the seat's show, found, price, held) for every listed id.
    found: the id is a seat (of the request's show when ``match_show``); held: that seat is unavailable.
    Ids are looked up in the request's show; those not found there, if any seat will do, in all shows."""
    pairs = reqs.select("request_id", "requested_at", "show_id", F.explode("seat_ids").alias("seat_id"))
    seats = st["seats"].select("seat_id", "show_id", "price", "is_available")
    own = seats_asked(seats, pairs.select("show_id", "seat_id")).withColumn("found", F.lit(True))
    looked = pairs.join(own, ["show_id", "seat_id"], "left").withColumn("_sshow", F.when(F.col("found"), F.col("show_id")))
    cols = ["request_id", "requested_at", "seat_id", "_sshow", F.coalesce("found", F.lit(False)).alias("found"), "price",
            F.coalesce(F.col("is_available") == 0, F.lit(False)).alias("held")]
    if match_show:
        return materialize(looked.select(*cols), "alloc-pairs")
    looked = materialize(looked.select(*cols), "alloc-pairs")
    lost = looked.filter("not found").select("request_id", "requested_at", "seat_id")
    if lost.isEmpty():
        return looked
    ids = materialize(lost.select("seat_id").filter("seat_id is not null").distinct(), "alloc-lost")
    if ids.limit(SENT_IDS + 1).count() <= SENT_IDS:  # sent to where the seats are
        there = seats.join(F.broadcast(ids), "seat_id", "left_semi")
    else:  # a task's lost ids are hashed and the seats pass by them: no seat is sorted
        there = seats.hint("shuffle_replicate_nl").join(ids.hint("shuffle_hash"), "seat_id", "left_semi")
    any_show = materialize(there.withColumnRenamed("show_id", "_sshow"), "alloc-elsewhere")
    elsewhere = lost.join(any_show.withColumn("found", F.col("_sshow").isNotNull()), "seat_id", "left").select(*cols)
    return materialize(looked.filter("found").unionByName(elsewhere), "alloc-pairs")


def _seat_check(reqs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per request with seats: (seat_ok, seat_total).  OK iff every listed id was found and no id repeats:
    the reference compares the number of matching seat rows with the length of the list."""
    once = reqs.select("request_id", (F.size(F.array_distinct("seat_ids")) == F.size("seat_ids")).alias("_once"))
    per = pairs.groupBy("request_id").agg(F.bool_and("found").alias("_all"), F.sum(F.when(F.col("found"), F.col("price"))).alias("seat_total"))
    return per.join(once, "request_id").select("request_id", (F.col("_all") & F.col("_once")).alias("seat_ok"), "seat_total")


def _food_check(st: dict, reqs: DataFrame) -> DataFrame:
    """Per request with food: (food_ok, food_total); ok iff every food id exists and none repeats."""
    lines = reqs.select("request_id", F.explode("food").alias("f")).select(
        "request_id", F.col("f.food_id").alias("food_id"), F.col("f.quantity").alias("quantity"))
    j = lines.join(st["food_items"].select("food_id", "price"), "food_id", "left")
    return j.groupBy("request_id").agg(
        (F.count(F.lit(1)) == F.count_distinct(F.when(F.col("price").isNotNull(), F.col("food_id")))).alias("food_ok"),
        F.sum(F.col("price") * F.col("quantity")).alias("food_total"))


def _serve(pdf):
    """One conflict component in order: a request gets its seats if all are still free."""
    taken, won = set(), []
    pdf = pdf.sort_values(["requested_at", "request_id"])
    for rid, seats in pdf.groupby(["requested_at", "request_id"], sort=False)["seat_id"]:
        ids = set(seats)
        if not taken & ids:
            taken |= ids
            won.append(rid[1])
    return pdf[pdf["request_id"].isin(won)][["request_id", "requested_at", "seat_id"]]


def fixpoint(pairs: DataFrame, task_pairs: int = TASK_PAIRS) -> tuple[DataFrame, int]:
    """Lexicographically-first independent set over (request_id, requested_at, seat_id, held) pairs.

    held: the seat is unavailable from the start.  Returns the pairs of the accepted requests
    (request_id, requested_at, seat_id) and the number of rounds.  Per round, one aggregate by seat
    gives the earliest undecided key and whether the seat is taken; one aggregate by request decides:
    any taken seat -> rejected, earliest on all seats -> accepted, else undecided.  Seats taken by
    round r's winners reject their rivals in round r + 1, after which no undecided pair touches them.
    After SET_ROUNDS rounds what is left is served by component, in slices where that is large."""
    key = F.struct(F.col("requested_at").alias("t"), F.col("request_id").alias("i"))
    und = pairs.select("request_id", "requested_at", "seat_id", F.col("held").cast("int").alias("_t"))
    parts: list[DataFrame] = []
    rounds = 0
    cols = ["request_id", "requested_at", "seat_id"]
    while True:
        rounds += 1
        first = und.groupBy("seat_id").agg(F.min(key).alias("_m"))
        decision = (und.join(first, "seat_id").groupBy("request_id")
                    .agg(F.max("_t").alias("_hit"), F.bool_and(key == F.col("_m")).alias("_first"))
                    .select("request_id", F.when(F.col("_hit") == 1, F.lit("R"))
                            .when(F.col("_first"), F.lit("A")).otherwise(F.lit("U")).alias("_d")))
        decided = materialize(und.join(decision, "request_id"), f"alloc-round-{rounds}")
        won = decided.filter(F.col("_d") == "A").select(*cols)
        parts.append(won)
        und = decided.filter(F.col("_d") == "U").select(*cols)
        if und.isEmpty():
            break
        taken = won.select("seat_id").distinct().withColumn("_t", F.lit(1))
        und = und.join(taken, "seat_id", "left").select(*cols, F.coalesce("_t", F.lit(0)).alias("_t"))
        if rounds == SET_ROUNDS:
            small, large = _split(und, task_pairs)
            parts.append(materialize(small.groupBy("component").applyInPandas(_serve, SERVED), "alloc-served"))
            if not large.isEmpty():
                served, slices = _in_slices(large, task_pairs)
                parts.append(served)
                rounds += slices
            break
    accepted = parts[0]
    for p in parts[1:]:
        accepted = accepted.unionByName(p)
    return accepted, rounds


def _split(und: DataFrame, task_pairs: int) -> tuple[DataFrame, DataFrame]:
    """The undecided pairs by conflict component: those of the components that fit a task, and the others."""
    lost = und.groupBy("request_id").agg(F.max("_t").alias("_h")).where("_h = 1").select("request_id")
    und = materialize(und.join(lost, "request_id", "left_anti"), "alloc-undecided")
    hub = und.groupBy("seat_id").agg(F.min("request_id").alias("b"))
    links = und.join(hub, "seat_id").select(F.col("request_id").alias("a"), "b")
    label = components(links, "alloc-components").withColumnRenamed("vertex", "request_id")
    und = materialize(und.join(label, "request_id", "left").withColumn("component", F.coalesce("component", "request_id")).drop("_t"), "alloc-labelled")
    size = und.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    und = und.join(size, "component")
    return und.where(F.col("_n") <= task_pairs).drop("_n"), und.where(F.col("_n") > task_pairs).drop("_n")


def _in_slices(und: DataFrame, task_pairs: int) -> tuple[DataFrame, int]:
    """Large components, each cut into slices of its arrival order of about ``task_pairs`` pairs.

    Slice by slice: requests that touch a seat taken in an earlier slice are out, the others of a component's slice are served
    in order within one task, and the seats that they take go on to the next slice.  The number of jobs follows the
    largest component's slices, whatever the chains of conflicts in them."""
    order = ["component", "requested_at", "request_id", "seat_id"]
    placed = materialize(assign_ids(und, order, 0, "_at"), "alloc-placed")
    first = placed.groupBy("component").agg(F.min("_at").alias("_first"))
    of = placed.groupBy("component", "request_id").agg(F.min("_at").alias("_lead")).join(first, "component").select(
        "request_id", F.floor((F.col("_lead") - F.col("_first")) / task_pairs).cast("int").alias("slice"))
    sliced = materialize(placed.drop("_at").join(of, "request_id"), "alloc-sliced")
    slices = sliced.agg(F.max("slice")).first()[0] + 1
    taken = None
    for k in range(slices):
        now = sliced.where(F.col("slice") == k)
        if taken is not None:
            out = now.join(taken.select("seat_id"), "seat_id", "left_semi").select("request_id").distinct()
            now = now.join(out, "request_id", "left_anti")
        served = materialize(now.groupBy("component").applyInPandas(_serve, SERVED), f"alloc-slice-{k}")
        taken = served if taken is None else taken.unionByName(served)
    return taken, slices


def allocate_seats(st: dict, reqs: DataFrame, match_show: bool = True, count_food: bool = True,
                   payment_status: str = "SUCCESS", return_rounds: bool = False):
    """POST /bookings for a batch (M1).  Returns ``(new_state, outcomes)``.

    Checks per request, in the reference's order: non-empty seat list
    (INVALID_REQUEST) -> every seat exists for the show, no repeats
    (INVALID_SEAT) -> all seats free at the request's turn (CONFLICT, with the
    unavailable ids) -> food ids exist, no repeats (INVALID_FOOD).  Accepted
    bookings are CONFIRMED with total = seats + food (``count_food``) and a
    payment (``payment_status``; SUCCESS has paid_at = requested_at; method
    default UPI).  Booking ids continue the existing ids in arrival order.
    """
    # the batch is read by every phase below: materialise it once (one write, no re-derivation)
    reqs = materialize(reqs.select("request_id", "requested_at", "user_id", "show_id", "seat_ids", "food",
                                   "payment_method"), "alloc-requests")
    base = reqs.select("request_id", "requested_at", "user_id", "show_id",
                       (F.coalesce(F.size("seat_ids"), F.lit(0)) < 1).alias("_empty"))
    pairs = _seat_pairs(st, reqs, match_show)
    checks = (base.join(_seat_check(reqs, pairs), "request_id", "left")
              .join(_food_check(st, reqs), "request_id", "left")
              .withColumn("food_ok", F.coalesce("food_ok", F.lit(True)))
              .withColumn("seat_ok", F.coalesce("seat_ok", F.lit(False)) & ~F.col("_empty")))
    checks = materialize(checks, "alloc-checks")

    # claimers: valid seats and valid food; a bad-food request never holds seats
    valid = pairs.join(checks.filter("seat_ok").select("request_id", "food_ok"), "request_id")
    accepted, rounds = fixpoint(valid.filter("food_ok").select("request_id", "requested_at", "seat_id", "held"))
    accepted = materialize(accepted, "alloc-accepted")

    # seats unavailable at each seat-valid request's turn: taken before the batch,
    # or held by an accepted request that comes earlier
    holder = accepted.select("seat_id", F.struct("requested_at", "request_id").alias("_h"))
    blocked = (valid.join(holder, "seat_id", "left")
               .filter(F.col("held") | (F.col("_h") < F.struct("requested_at", "request_id")))
               .groupBy("request_id")
               .agg(F.array_sort(F.array_distinct(F.collect_list("seat_id"))).alias("unavailable_seats")))
    acc_ids = accepted.select("request_id").distinct().withColumn("_acc", F.lit(True))

    outcome = (checks.join(acc_ids, "request_id", "left").join(blocked, "request_id", "left")
               .withColumn("outcome",
                           F.when(F.col("_empty"), F.lit(OUTCOME_INVALID_REQUEST))
                           .when(~F.col("seat_ok"), F.lit(OUTCOME_INVALID_SEAT))
                           .when(F.col("unavailable_seats").isNotNull(), F.lit(OUTCOME_CONFLICT))
                           .when(~F.col("food_ok"), F.lit(OUTCOME_INVALID_FOOD))
                           .when(F.col("_acc"), F.lit(OUTCOME_ACCEPTED))
                           .otherwise(F.raise_error(F.lit("request left undecided")))))
    outcome = materialize(outcome, "alloc-outcomes")
    zero = F.lit(Decimal("0.00"))
    total = (F.coalesce("seat_total", zero) + (F.coalesce("food_total", zero) if count_food else zero)).cast("decimal(10,2)")
    start = _last(st["bookings"], "booking_id")
    won = assign_ids(outcome.filter(F.col("outcome") == OUTCOME_ACCEPTED)
                     .select("request_id", "requested_at", "user_id", "show_id", total.alias("total_amount")),
                     ["requested_at", "request_id"], start, "booking_id")
    outcomes = (outcome.join(won.select("request_id", "booking_id", "total_amount"), "request_id", "left")
                .select("request_id", "user_id", "show_id", "outcome", "booking_id", "total_amount",
                        "unavailable_seats"))

    new = won.join(reqs.select("request_id", "seat_ids", "food", "payment_method"), "request_id")
    new_bookings = new.select("booking_id", "user_id", "show_id", F.col("requested_at").alias("booking_date"),
                              "total_amount", F.lit("CONFIRMED").alias("booking_status"), F.lit(0).alias("reminder_sent"))
    new_lines = assign_ids(new.select("booking_id", F.explode("seat_ids").alias("seat_id")), ["booking_id", "seat_id"],
                           _last(st["booking_seats"], "bs_id"), "bs_id")
    new_food = assign_ids(new.select("booking_id", F.posexplode("food").alias("_pos", "f")), ["booking_id", "_pos"],
                          _last(st["booking_food"], "bf_id"), "bf_id").select(
        "bf_id", "booking_id", F.col("f.food_id").alias("food_id"), F.col("f.quantity").alias("quantity"))
    paid = F.when(F.lit(payment_status) == "SUCCESS", F.col("requested_at")).cast("timestamp_ntz")
    new_pay = assign_ids(new.select("booking_id", F.col("total_amount").alias("amount"),
                                    F.coalesce("payment_method", F.lit(DEFAULT_METHOD)).alias("payment_method"),
                                    F.lit(payment_status).alias("payment_status"), paid.alias("paid_at")),
                         ["booking_id"], _last(st["payments"], "payment_id"), "payment_id")
    # a show's sold seats (at most all its seats) go to where its seats are
    sold = (accepted.select("seat_id").distinct().join(pairs.filter("found").select("seat_id", F.col("_sshow").alias("show_id")).distinct(), "seat_id")
            .groupBy("show_id").agg(F.collect_set("seat_id").alias("_sold")))
    seats = (st["seats"].hint("shuffle_replicate_nl").join(sold.hint("shuffle_hash"), "show_id", "left")
             .withColumn("is_available", F.when(F.array_contains("_sold", F.col("seat_id")), F.lit(0)).otherwise(F.col("is_available"))))
    out = copy(st)
    out["bookings"] = conform(st["bookings"], "bookings").unionByName(conform(new_bookings, "bookings"))
    out["booking_seats"] = conform(st["booking_seats"], "booking_seats").unionByName(conform(new_lines, "booking_seats"))
    out["booking_food"] = conform(st["booking_food"], "booking_food").unionByName(conform(new_food, "booking_food"))
    out["payments"] = conform(st["payments"], "payments").unionByName(conform(new_pay, "payments"))
    out["seats"] = conform(seats, "seats")
    return (out, outcomes, rounds) if return_rounds else (out, outcomes)


def quick_book_two(st: dict, reqs: DataFrame):
    """sp_create_booking (M17): two seats and optional food per request.  Seats are
    only checked to exist and be free (not to belong to the show); the total is
    seats only; the booking is CONFIRMED with a PENDING UPI payment.  Requests are
    (request_id, requested_at, user_id, show_id, seat_id1, seat_id2, food_id, food_qty)."""
    food = F.when((F.col("food_id") > 0) & (F.col("food_qty") > 0),
                  F.array(F.struct(F.col("food_id").cast("long").alias("food_id"),
                                   F.col("food_qty").cast("int").alias("quantity")))) \
            .otherwise(F.array().cast("array<struct<food_id:bigint,quantity:int>>"))
    as_booking = reqs.select("request_id", "requested_at", "user_id", "show_id",
                             F.array(F.col("seat_id1").cast("long"), F.col("seat_id2").cast("long")).alias("seat_ids"),
                             food.alias("food"), F.lit(DEFAULT_METHOD).alias("payment_method"))
    return allocate_seats(st, as_booking, match_show=False, count_food=False, payment_status="PENDING")
