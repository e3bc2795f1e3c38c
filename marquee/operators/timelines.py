"""Replay of large seat-conflict components as a fixpoint over seat timelines.

In a log of book, cancel and payment commands only the acceptance of a book command
hangs on other bookings: once a booking is accepted, what its own cancel and
payment commands do, and when they free its seats, follows from its own commands.
So every booking's later commands are judged once, as if it had been accepted
(windows over its own commands), and what is left to find is which book commands
are accepted:

  guess all valid book commands accepted; then repeat: lay the events of the accepted
  bookings (seats taken, seats freed) on each seat's timeline, see for every book command
  whether the last event before it on any of its seats took that seat, and take the
  answers as the next guess.

A command's answer is right once all earlier commands of its seats are, so the
guesses settle from the start of the log on, and a guess that comes back unchanged
is the sequential answer (there is only one).  Each round is a window by seat
and an aggregate by booking over all tasks; components whose guess did not change
leave.  Components that still change after ``rounds`` rounds are given back, to be replayed in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.plans.lineage import materialize

KEY = ("ts", "cmd_id")


def booking_commands(log: DataFrame) -> DataFrame:
    """The cancel and payment commands of booked bookings with their outcome if the booking is accepted (``if_*``) and
    if not (``not_outcome``), and whether they free its seats (``frees``)."""
    book = log.filter("kind = 'book'").select("booking_id", F.col("actor_id").alias("_owner"), F.struct(*KEY).alias("_booked"))
    c = log.filter("kind <> 'book'").join(book, "booking_id")
    known = F.coalesce(F.col("payment_status").isin("SUCCESS", "FAILED"), F.lit(False))
    after = F.struct(*KEY) > F.col("_booked")
    may = (F.col("actor_id") == F.col("_owner")) | F.coalesce("actor_is_admin", F.lit(False))
    c = c.withColumns({"_cancel": F.col("kind") == "cancel", "_known": known, "_after": after, "_may": may})
    own = Window.partitionBy("booking_id").orderBy(*KEY)
    paid = F.when(~F.col("_cancel") & F.col("_known") & F.col("_after") & F.col("_may"), F.col("payment_status"))
    c = c.withColumn("_paid", F.last(paid, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    live = F.coalesce(F.col("_paid") == "SUCCESS", F.lit(True))  # neither failed nor, below, cancelled
    ends = F.when(F.col("_cancel") & F.col("_after") & F.col("_may") & live, F.struct(*KEY))
    c = c.withColumn("_ends", F.min(ends).over(Window.partitionBy("booking_id")))
    over = F.coalesce(F.struct(*KEY) > F.col("_ends"), F.lit(False))
    ending = F.coalesce(F.struct(*KEY) == F.col("_ends"), F.lit(False))
    status = F.when(over | ~live, "CANCELLED").otherwise("CONFIRMED")
    nothing = F.when(F.col("_cancel") | F.col("_known"), "NOT_FOUND").otherwise("INVALID_STATUS")
    outcome = (F.when(~F.col("_after"), nothing)
               .when(F.col("_cancel"), F.when(~F.col("_may"), "FORBIDDEN").when(ending, "CANCELLED").otherwise("ALREADY_CANCELLED"))
               .when(~F.col("_known"), "INVALID_STATUS").when(over, "NOT_FOUND").when(~F.col("_may"), "FORBIDDEN").otherwise("APPLIED"))
    c = c.withColumns({"if_outcome": outcome, "not_outcome": nothing, "_status": status})
    applied = F.col("if_outcome") == "APPLIED"
    left = (F.when(~F.col("_after"), F.lit(None)).when(F.col("if_outcome") == "CANCELLED", "CANCELLED")
            .when(applied, F.when(F.col("payment_status") == "FAILED", "CANCELLED").otherwise("CONFIRMED")).otherwise(F.col("_status")))
    frees = (F.col("if_outcome") == "CANCELLED") | applied & (F.col("payment_status") == "FAILED")
    return c.select("part", "show_id", *KEY, "kind", "booking_id", "if_outcome", left.alias("if_status"), "not_outcome", frees.alias("frees"))


def _hits(rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """(part, booking_id, seat_id, hit) of every book command and seat: whether the seat is taken when its turn comes."""
    marked = rows.join(accepted, ["part", "booking_id"], "left")
    turn = Window.partitionBy("seat_id").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("accepted"), F.col("take")), ignorenulls=True).over(turn)
    return marked.select("part", "booking_id", "seat_id", "take", F.coalesce(before, F.lit(False)).alias("hit")).filter("take").drop("take")


def replay_large(log: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame, int]:
    """log: commands of known shows with ``part`` (a written table).  Returns the outcomes of the parts that settled, the parts
    that did not (``part``), and the number of rounds."""
    book = log.filter("kind = 'book'")
    others = materialize(booking_commands(log), "timeline-commands")
    frees = others.filter("frees").select("part", "booking_id", *KEY).join(book.filter("seat_ok").select("booking_id", "seat_ids"), "booking_id")
    rows = book.filter("seat_ok").select("part", "booking_id", *KEY, F.explode("seat_ids").alias("seat_id"), F.lit(True).alias("take")).unionByName(
        frees.select("part", "booking_id", *KEY, F.explode("seat_ids").alias("seat_id"), F.lit(False).alias("take")))
    rows = materialize(rows, "timeline-rows")
    # a part in which a booking is booked twice has no single owner and start
    twice = book.groupBy("part", "booking_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("part").distinct()
    guess = materialize(book.filter("seat_ok and food_ok").join(twice, "part", "left_anti").select("part", "booking_id", F.lit(True).alias("accepted")), "timeline-guess")
    settled, moving, count = [], guess.select("part").distinct(), 0
    while count < rounds:
        count += 1
        hit = _hits(rows.join(moving, "part", "left_semi"), guess).groupBy("part", "booking_id").agg(F.bool_or("hit").alias("hit"))
        new = materialize(guess.withColumnRenamed("accepted", "before").join(hit, ["part", "booking_id"]).select(
            "part", "booking_id", (~F.col("hit")).alias("accepted"), "before"), f"timeline-round-{count}")
        moving = materialize(new.filter("accepted <> before").select("part").distinct(), "timeline-moving")
        settled.append(new.join(moving, "part", "left_anti").select("part", "booking_id", "accepted"))
        guess = new.join(moving, "part", "left_semi").select("part", "booking_id", "accepted")
        if moving.isEmpty():
            break
    accepted = settled[0]
    for s in settled[1:]:
        accepted = accepted.unionByName(s)
    accepted = materialize(accepted, "timeline-accepted")
    left = materialize(moving.unionByName(twice).distinct(), "timeline-left")

    done = log.join(left, "part", "left_anti")
    hits = _hits(rows.join(left, "part", "left_anti"), accepted).filter("hit").groupBy("booking_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("seat_id")), lambda s: s.cast("string")), ",").alias("unavailable_seats"))  # a request's seats
    outcome = (F.when(~F.col("seat_ok"), "INVALID_SEAT").when(F.col("unavailable_seats").isNotNull(), "CONFLICT")
               .when(~F.col("food_ok"), "INVALID_FOOD").otherwise("ACCEPTED"))
    booked = done.filter("kind = 'book'").join(hits, "booking_id", "left").withColumn("outcome", outcome)
    booked = booked.select("show_id", *KEY, "kind", "booking_id", "outcome", F.when(F.col("outcome") == "ACCEPTED", "CONFIRMED").alias("booking_status"),
                           F.when(F.col("outcome") == "CONFLICT", F.col("unavailable_seats")).alias("unavailable_seats"))
    took = accepted.filter("accepted").select("booking_id", F.lit(True).alias("_took"))
    judged = others.join(left, "part", "left_anti").join(took, "booking_id", "left")
    judged = judged.select("show_id", *KEY, "kind", "booking_id", F.when(F.col("_took"), F.col("if_outcome")).otherwise(F.col("not_outcome")).alias("outcome"),
                           F.when(F.col("_took"), F.col("if_status")).alias("booking_status"), F.lit(None).cast("string").alias("unavailable_seats"))
    return booked.unionByName(judged), left, count
