"""Seats are looked up where they lie: only those that may be asked for leave their shows."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from marquee.operators import allocate as AL
from marquee.operators import apply as AP
from marquee.operators import notices as N
from marquee.plans.lineage import materialize
from marquee.sources.schemas import TABLES

T0 = dt.datetime(2001, 1, 1)


def seat_table(spark, shows=40, per_show=50):
    rows = spark.range(shows * per_show).select(
        F.col("id").alias("seat_id"), F.floor(F.col("id") / per_show).alias("show_id"), F.lit("A").alias("row_letter"),
        (F.col("id") % per_show + 1).cast("int").alias("seat_number"), F.lit("VIP").alias("seat_type"),
        F.lit(1).alias("is_available"), F.lit(D("10.00")).cast("decimal(10,2)").alias("price"))
    return rows.repartition(4, "show_id").hint("merge")


def shuffled(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def empty(spark, name):
    return spark.createDataFrame([], TABLES[name])


def test_only_seats_asked_for_leave_their_shows(spark):
    asked = spark.createDataFrame([(s, s * 50 + k) for s in range(0, 40, 2) for k in (3, 7, 999)], "show_id long, seat_id long")
    seats = AL.seats_asked(seat_table(spark), asked)
    rows = {(r.show_id, r.seat_id) for r in seats.collect()}
    assert {(s, s * 50 + k) for s in range(0, 40, 2) for k in (3, 7)} <= rows and len(rows) < 80
    assert not any("seat_id" in line.split("hashpartitioning(")[1].split(")")[0] for line in shuffled(seats))


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_seats_of_other_shows_count_where_any_seat_will_do(spark, monkeypatch, sent):
    monkeypatch.setattr(AL, "SENT_IDS", sent)
    st = {"seats": seat_table(spark)}
    reqs = spark.createDataFrame([(1, T0, 0, [3, 60]), (2, T0, 1, [51, 99999]), (3, T0, None, [5, None])],
                                 "request_id long, requested_at timestamp_ntz, show_id long, seat_ids array<long>")
    look = lambda match: {(r.request_id, r.seat_id): (r.found, r._sshow) for r in AL._seat_pairs(st, reqs, match).collect()}
    assert look(True) == {(1, 3): (True, 0), (1, 60): (False, None), (2, 51): (True, 1), (2, 99999): (False, None), (3, 5): (False, None), (3, None): (False, None)}
    assert look(False) == {(1, 3): (True, 0), (1, 60): (True, 1), (2, 51): (True, 1), (2, 99999): (False, None), (3, 5): (True, 0), (3, None): (False, None)}


def test_sold_seats_of_any_show_are_marked(spark):
    st = {"seats": seat_table(spark), "food_items": empty(spark, "food_items"),
          **{t: empty(spark, t) for t in ("bookings", "booking_seats", "booking_food", "payments")}}
    reqs = spark.createDataFrame([(1, T0, 9, 0, 3, 60, 0, 0), (2, T0 + dt.timedelta(1), 9, 1, 60, 61, 0, 0)],
                                 "request_id long, requested_at timestamp_ntz, user_id long, show_id long, seat_id1 long, seat_id2 long, food_id long, food_qty int")
    after, out = AL.quick_book_two(st, reqs)
    assert {r.request_id: r.outcome for r in out.collect()} == {1: "ACCEPTED", 2: "CONFLICT"}
    assert {r.seat_id for r in after["seats"].filter("is_available = 0").collect()} == {3, 60} and after["seats"].count() == 2000
    # the seats stay where their shows are
    assert not any("seat_id" in line.split("hashpartitioning(")[1].split(")")[0] and "row_letter" in line for line in shuffled(after["seats"]))


def test_reminders_leave_the_seats_where_they_are(spark, monkeypatch):
    show = (7, "T", None, dt.date(2001, 1, 2), "18:00:00", 1, 1, D("1.00"), D("0.00"))
    st = {"seats": seat_table(spark), "shows": spark.createDataFrame([show], "show_id long, title string, description string, show_date date, show_time string, "
                                                                     "venue_id long, category_id long, base_price decimal(10,2), avg_rating decimal(3,2)"),
          "users": spark.createDataFrame([(1, "N", "e")], "user_id long, full_name string, email string"),
          "venues": spark.createDataFrame([(1, "V", "C")], "venue_id long, venue_name string, city string"),
          "bookings": spark.createDataFrame([(5, 1, 7, D("1.00"), "CONFIRMED", 0)],
                                            "booking_id long, user_id long, show_id long, total_amount decimal(10,2), booking_status string, reminder_sent int"),
          "booking_seats": spark.createDataFrame([(5, 352), (5, 351), (6, 1)], "booking_id long, seat_id long")}
    for limit, sent in ((200_000, True), (1, False)):  # few lines are sent, more are dealt
        monkeypatch.setattr(N, "SENT_LINES", limit)
        due = N.reminders_due(st, "2001-01-01")
        assert [(r.booking_id, r.seat_labels) for r in due.collect()] == [(5, "A2, A3")]
        assert any("seat_id" in line and "row_letter" not in line for line in shuffled(due)) != sent


def test_only_taken_seats_meet_the_freed_ones(spark):
    seats = seat_table(spark).withColumn("is_available", F.when(F.col("seat_id") % 50 == 0, 0).when(F.col("seat_id") == 7, None).otherwise(1)).unionByName(seat_table(spark).filter("seat_id = 50").withColumn("is_available", F.lit(0)))
    freed = spark.createDataFrame([(0,), (0,), (7,), (9,), (50,), (None,), (99999,)], "seat_id long")
    after = AP.free_seats(seats, freed)
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(seat_id") == 2 and "Sort [seat_id" not in plan  # of taken and of freed seats
    rows = {(r.seat_id, r.is_available) for r in after.collect()}
    assert after.count() == 2001 and {(0, 1), (7, 1), (9, 1), (50, 1), (100, 0)} <= rows and sum(a == 0 for _, a in rows) == 38


def test_cancellations_are_decided_once_for_all_tables(spark, seed, monkeypatch):
    written = []
    monkeypatch.setattr(AP, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    reqs = spark.createDataFrame([(1, T0, 1, 2, True), (2, T0, 999, 2, True)], "request_id long, requested_at timestamp_ntz, booking_id long, actor_id long, actor_is_admin boolean")
    after, out = AP.cancel_bookings(seed, reqs)
    assert out.count() == 2 and written == []  # outcomes alone write nothing
    assert all(after[t].count() >= 0 for t in ("bookings", "booking_seats", "booking_food", "payments", "seats")) and written == ["cancelled"]
    assert after["bookings"].filter("booking_id = 1").head().booking_status == "CANCELLED" and after["booking_seats"].filter("booking_id = 1").isEmpty()
