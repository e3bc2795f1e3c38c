"""Ordered replay of a booking command log (M16) and its keyed state (used by T1).

Book, cancel and payment-result commands interact (a FAILED result frees seats
but keeps the lines, a later SUCCESS re-confirms without re-claiming them), so
the outcome of a command depends on every earlier command of the same show;
shows are independent.  So are, within a show, bookings that no chain of shared
seats connects: the batch job labels every booking with its seat-conflict
component (rounds grow with the logarithm of the chain), hash-partitions the log
by component, sorts each partition by (component, time, id) and streams it through
``mapInPandas``: the task keeps the ledger of *one* component at a time, never a
list of its commands, and a show with a third of all commands spreads over as
many tasks as it has components.  Components too large for that go through the
fixpoint over seat timelines (``timelines``), which no single task serves.

Everything a command needs from the static tables (seat existence and prices,
food prices) is attached by joins before the replay, so the per-row Python is
a small state machine, not a query engine.
"""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.allocate import DEFAULT_METHOD, _food_check, _seat_check, _seat_pairs
from marquee.operators.timelines import replay_large
from marquee.plans.components import components
from marquee.plans.lineage import materialize

LARGE, ROUNDS = 20_000, 40
NOBODY = -(2**63)  # stands for an unknown (NULL) actor in a log: owns nothing

# Python workers receive this module's functions by value (cloudpickle), so executors
# need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMMAND_SCHEMA = T.StructType([
    T.StructField("show_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("cmd_id", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("booking_id", T.LongType()), T.StructField("actor_id", T.LongType()),
    T.StructField("actor_is_admin", T.BooleanType()), T.StructField("seat_ids", T.ArrayType(T.LongType())),
    T.StructField("seat_ok", T.BooleanType()), T.StructField("food_ok", T.BooleanType()),
    T.StructField("total", T.DecimalType(18, 2)), T.StructField("payment_status", T.StringType()),
    T.StructField("payment_method", T.StringType()),
])
OUTCOME_SCHEMA = T.StructType([
    T.StructField("show_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("cmd_id", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("booking_id", T.LongType()),
    T.StructField("outcome", T.StringType()), T.StructField("booking_status", T.StringType()),
    T.StructField("unavailable_seats", T.StringType()),
])


class ShowLedger:
    """State of one show: unavailable seats and its bookings (owner, status, lines, payment)."""

    def __init__(self, data: dict | None = None):
        data = data or {}
        self.unavailable: set[int] = set(data.get("u", []))
        self.bookings: dict[int, dict] = {int(k): v for k, v in data.get("b", {}).items()}
        self.last: tuple | None = tuple(data["l"]) if data.get("l") else None

    def to_json(self) -> str:
        return json.dumps({"u": sorted(self.unavailable), "b": self.bookings, "l": list(self.last) if self.last else None})

    def apply(self, c) -> tuple[str, str | None, str | None]:
        """One command -> (outcome, booking status after it, unavailable seats text)."""
        kind = c.kind
        bid = int(c.booking_id)
        if kind == "book":
            seats = [int(s) for s in (c.seat_ids if c.seat_ids is not None else [])]
            if not c.seat_ok:
                return "INVALID_SEAT", None, None
            hit = sorted(set(s for s in seats if s in self.unavailable))
            if hit:
                return "CONFLICT", None, ",".join(map(str, hit))
            if not c.food_ok:
                return "INVALID_FOOD", None, None
            self.unavailable.update(seats)
            self.bookings[bid] = {"owner": int(c.actor_id), "status": "CONFIRMED", "seats": seats, "paid": True}
            return "ACCEPTED", "CONFIRMED", None
        b = self.bookings.get(bid)
        admin = bool(c.actor_is_admin)
        if kind == "cancel":
            if b is None:
                return "NOT_FOUND", None, None
            if b["owner"] != int(c.actor_id) and not admin:
                return "FORBIDDEN", b["status"], None
            if b["status"] == "CANCELLED":
                return "ALREADY_CANCELLED", b["status"], None
            self.unavailable.difference_update(b["seats"])  # lines deleted: the seats are freed
            b.update(status="CANCELLED", seats=[], paid=False)
            return "CANCELLED", "CANCELLED", None
        # payment result
        if c.payment_status not in ("SUCCESS", "FAILED"):
            return "INVALID_STATUS", b["status"] if b else None, None
        if b is None or not b["paid"]:
            return "NOT_FOUND", b["status"] if b else None, None
        if b["owner"] != int(c.actor_id) and not admin:
            return "FORBIDDEN", b["status"], None
        if c.payment_status == "FAILED":
            self.unavailable.difference_update(b["seats"])  # seats freed, lines kept
            b["status"] = "CANCELLED"
        else:
            b["status"] = "CONFIRMED"  # re-confirmed without re-claiming its seats
        return "APPLIED", b["status"], None


def _replay_partition(batches):
    """mapInPandas body: rows arrive sorted by (part, ts, cmd_id); one ledger at a time."""
    ledger, current = None, None
    for pdf in batches:
        out = []
        for c in pdf.itertuples(index=False):
            if c.part != current:
                current, ledger = c.part, ShowLedger()
            outcome, status, unavail = ledger.apply(c)
            out.append((c.show_id, c.ts, c.cmd_id, c.kind, c.booking_id, outcome, status, unavail))
        yield pd.DataFrame(out, columns=[f.name for f in OUTCOME_SCHEMA.fields])


#: Besides a command's outcome: its booking's seat lines and what became of them (is_available -1: nothing), or,
#: as rows of kind BOOKING, a booking as its part's commands left it.
BOOKING, SEAT = "=booking", "=seat"
CHANGE_SCHEMA = T.StructType([*OUTCOME_SCHEMA.fields, T.StructField("seat_ids", T.ArrayType(T.LongType())), T.StructField("is_available", T.IntegerType()),
                              T.StructField("owner", T.LongType()), T.StructField("paid", T.BooleanType())])


def _replay_from_state(batches):
    """mapInPandas body like ``_replay_partition``; a part's first rows (prio 0) are its bookings and taken seats so far."""
    def left(ledger, shows):
        return [(shows[k], None, 0, BOOKING, k, None, b["status"], None, b["seats"], -1, b["owner"], b["paid"]) for k, b in ledger.bookings.items()]

    ledger, current, shows = ShowLedger(), None, {}
    for pdf in batches:
        out = []
        for c in pdf.itertuples(index=False):
            if c.part != current:
                out.extend(left(ledger, shows))
                current, ledger, shows = c.part, ShowLedger(), {}
            bid = int(c.booking_id)
            lines = [int(s) for s in c.seat_ids] if c.seat_ids is not None else []
            if c.kind == SEAT:
                ledger.unavailable.update(lines)
                continue
            shows[bid] = c.show_id
            if c.kind == BOOKING:
                ledger.bookings[bid] = {"owner": int(c.actor_id), "status": c.payment_status, "seats": lines, "paid": bool(c.seat_ok)}
                continue
            held = list(ledger.bookings[bid]["seats"]) if bid in ledger.bookings else []
            outcome, status, unavail = ledger.apply(c)
            free = outcome == "CANCELLED" or outcome == "APPLIED" and status == "CANCELLED"
            out.append((c.show_id, c.ts, c.cmd_id, c.kind, bid, outcome, status, unavail, lines if outcome == "ACCEPTED" else held if free else [],
                        0 if outcome == "ACCEPTED" else 1 if free else -1, 0, False))
        yield pd.DataFrame(out, columns=[f.name for f in CHANGE_SCHEMA.fields])
    yield pd.DataFrame(left(ledger, shows), columns=[f.name for f in CHANGE_SCHEMA.fields])


def replay_from_state(log: DataFrame, bookings: DataFrame, seats: DataFrame) -> DataFrame:
    """CHANGE_SCHEMA rows of the commands of ``log`` (a written table, show_id known) after ``bookings`` (show_id, booking_id,
    owner, booking_status, seat_ids, paid) and ``seats`` (show_id, seat_id, is_available), dealt out by seat-conflict component:
    the bookings that the log names, linked by the seats that they hold or ask for."""
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = materialize(bookings.join(log.select("show_id", "booking_id").distinct(), ["show_id", "booking_id"], "left_semi"), "replay-known")
    held = materialize(log.filter("kind = 'book' and seat_ok").select("show_id", "booking_id", F.explode("seat_ids").alias("seat_id"))
                       .unionByName(known.select("show_id", "booking_id", F.explode("seat_ids").alias("seat_id"))).distinct(), "replay-held")
    hub = held.groupBy("seat_id").agg(F.min("booking_id").alias("b"))
    label = components(held.join(hub, "seat_id").select(F.col("booking_id").alias("a"), "b"), "replay-parts").withColumnsRenamed(
        {"vertex": "booking_id", "component": "part"})
    part = F.coalesce("part", "booking_id").alias("part")
    # a seat's holders are of one part
    taken = (hub.join(label.withColumnRenamed("booking_id", "b"), "b", "left").select(F.coalesce("part", "b").alias("part"), "seat_id")
             .join(seats.filter("is_available = 0"), "seat_id"))
    cols = [f.name for f in COMMAND_SCHEMA.fields]

    def row(df, prio, **given):
        return df.select("part", F.lit(prio).alias("prio"), *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in COMMAND_SCHEMA.fields])

    nothing = {"cmd_id": F.lit(0), "actor_is_admin": F.lit(False), "food_ok": F.lit(True)}
    rows = (log.join(label, "booking_id", "left").select(part, F.lit(1).alias("prio"), *cols)
            .unionByName(row(known.join(label, "booking_id", "left").withColumn("part", part), 0, show_id=F.col("show_id"), kind=F.lit(BOOKING),
                             booking_id=F.col("booking_id"), actor_id=F.col("owner"), seat_ids=F.col("seat_ids"), seat_ok=F.col("paid"),
                             payment_status=F.col("booking_status"), **nothing))
            .unionByName(row(taken, 0, show_id=F.col("show_id"), kind=F.lit(SEAT), booking_id=F.lit(0), actor_id=F.lit(0), seat_ok=F.lit(True),
                             seat_ids=F.array("seat_id"), **nothing)))
    return rows.repartition(n, "part").sortWithinPartitions("part", "prio", "ts", "cmd_id").mapInPandas(_replay_from_state, CHANGE_SCHEMA)


def command_log(st: dict, book: DataFrame, cancel: DataFrame, payment: DataFrame) -> DataFrame:
    """One ordered log over the three request kinds.  booking_id of a book command is
    its request_id; cancel and payment rows take the show of their booking's book
    command (rows naming no booked booking keep a NULL show and are NOT_FOUND)."""
    checks = (book.select("request_id").join(_seat_check(book, _seat_pairs(st, book, True)), "request_id", "left")
              .join(_food_check(st, book), "request_id", "left"))
    zero = F.lit(0).cast("decimal(18,2)")
    b = book.join(checks, "request_id").select(
        "show_id", F.col("requested_at").alias("ts"), F.col("request_id").alias("cmd_id"), F.lit("book").alias("kind"),
        F.col("request_id").alias("booking_id"), F.col("user_id").alias("actor_id"), F.lit(False).alias("actor_is_admin"),
        "seat_ids", F.coalesce("seat_ok", F.lit(False)).alias("seat_ok"), F.coalesce("food_ok", F.lit(True)).alias("food_ok"),
        (F.coalesce("seat_total", zero) + F.coalesce("food_total", zero)).cast("decimal(18,2)").alias("total"),
        F.lit(None).cast("string").alias("payment_status"), "payment_method")
    shows = book.select(F.col("request_id").alias("booking_id"), "show_id")
    c = cancel.join(shows, "booking_id", "left").select(
        "show_id", F.col("requested_at").alias("ts"), F.col("request_id").alias("cmd_id"), F.lit("cancel").alias("kind"),
        "booking_id", "actor_id", "actor_is_admin", F.lit(None).cast("array<bigint>").alias("seat_ids"),
        F.lit(None).cast("boolean").alias("seat_ok"), F.lit(None).cast("boolean").alias("food_ok"),
        F.lit(None).cast("decimal(18,2)").alias("total"), F.lit(None).cast("string").alias("payment_status"),
        F.lit(None).cast("string").alias("payment_method"))
    p = payment.join(shows, "booking_id", "left").select(
        "show_id", F.col("requested_at").alias("ts"), F.col("request_id").alias("cmd_id"), F.lit("payment").alias("kind"),
        "booking_id", "actor_id", "actor_is_admin", F.lit(None).cast("array<bigint>").alias("seat_ids"),
        F.lit(None).cast("boolean").alias("seat_ok"), F.lit(None).cast("boolean").alias("food_ok"),
        F.lit(None).cast("decimal(18,2)").alias("total"), "payment_status", "payment_method")
    log = b.unionByName(c).unionByName(p).withColumns({
        "actor_id": F.coalesce("actor_id", F.lit(NOBODY)), "actor_is_admin": F.coalesce("actor_is_admin", F.lit(False))})
    return log.select([F.col(f.name).cast(f.dataType) for f in COMMAND_SCHEMA.fields])


def replay_booking_log(log: DataFrame, partitions: int | None = None, large: int = LARGE, rounds: int = ROUNDS) -> DataFrame:
    """Outcome of every command in show order.  Commands without a show (their
    booking was never booked) are NOT_FOUND without entering the replay.

    Seat-conflict components of at most ``large`` commands are replayed in order, each within one task; larger
    ones by the fixpoint over seat timelines, all tasks at once, and in order only if they have not settled after
    ``rounds`` rounds.  Both give the same answer."""
    spark = log.sparkSession
    log = materialize(log, "replay-log")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    orphan = log.filter(F.col("show_id").isNull()).select(
        "show_id", "ts", "cmd_id", "kind", "booking_id", F.lit("NOT_FOUND").alias("outcome"),
        F.lit(None).cast("string").alias("booking_status"), F.lit(None).cast("string").alias("unavailable_seats"))
    held = log.filter("kind = 'book' and seat_ok").select("booking_id", F.explode("seat_ids").alias("seat_id"))
    hub = held.groupBy("seat_id").agg(F.min("booking_id").alias("b"))
    label = components(held.join(hub, "seat_id").select(F.col("booking_id").alias("a"), "b"), "replay-parts").withColumnsRenamed(
        {"vertex": "booking_id", "component": "part"})
    known = log.filter(F.col("show_id").isNotNull()).join(label, "booking_id", "left").withColumn("part", F.coalesce("part", "booking_id"))
    big = materialize(known.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("part"), "replay-large")
    if big.isEmpty():
        return _in_order(known, n).unionByName(orphan)
    settled, left, _ = replay_large(materialize(known.join(big, "part", "left_semi"), "replay-large-log"), rounds)
    serial = known.join(big.join(left, "part", "left_anti"), "part", "left_anti")
    return _in_order(serial, n).unionByName(settled).unionByName(orphan)


def _in_order(log: DataFrame, n: int) -> DataFrame:
    return log.repartition(n, "part").sortWithinPartitions("part", "ts", "cmd_id").mapInPandas(_replay_partition, OUTCOME_SCHEMA)


def final_bookings(outcomes: DataFrame) -> DataFrame:
    """Final status of each accepted booking: the status after its last effective command."""
    eff = outcomes.filter(F.col("booking_status").isNotNull())
    return eff.groupBy("booking_id").agg(F.max_by("booking_status", F.struct("ts", "cmd_id")).alias("booking_status"),
                                         F.first("show_id").alias("show_id"))


def final_payments(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(booking_id, payment_status, payment_method, paid_at) of every payment left: accepted bookings
    pay at once; cancelling deletes the payment; results set status, method (if given) and paid_at."""
    done = outcomes.filter(F.col("outcome").isin("ACCEPTED", "CANCELLED", "APPLIED")).select("cmd_id", "kind", "booking_id", "ts")
    full = done.join(log.select("cmd_id", "kind", "payment_status", "payment_method"), ["cmd_id", "kind"])
    order = F.struct("ts", "cmd_id")
    status = F.when(F.col("kind") == "book", F.lit("SUCCESS")).otherwise(F.col("payment_status"))
    out = full.groupBy("booking_id").agg(
        F.max(F.col("kind") == "cancel").alias("gone"), F.max_by(F.struct(status.alias("s"), "ts"), order).alias("last"),
        F.max_by("payment_method", F.when(F.col("payment_method").isNotNull(), order)).alias("payment_method"))
    return out.filter("not gone").select("booking_id", F.col("last.s").alias("payment_status"),
                                         F.coalesce("payment_method", F.lit(DEFAULT_METHOD)).alias("payment_method"),
                                         F.when(F.col("last.s") == "SUCCESS", F.col("last.ts")).alias("paid_at"))


def final_seats(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(seat_id, is_available) of every seat that a booking took or freed: the last such event of a seat
    counts (an aggregate by seat, no list of its events)."""
    free = (F.col("outcome") == "CANCELLED") | ((F.col("outcome") == "APPLIED") & (F.col("booking_status") == "CANCELLED"))
    events = outcomes.filter((F.col("outcome") == "ACCEPTED") | free).select(
        "booking_id", "ts", "cmd_id", F.when(free, 1).otherwise(0).alias("is_available"))
    lines = log.filter("kind = 'book'").select("booking_id", F.explode("seat_ids").alias("seat_id"))
    return events.join(lines, "booking_id").groupBy("seat_id").agg(F.max_by("is_available", F.struct("ts", "cmd_id")).alias("is_available"))
