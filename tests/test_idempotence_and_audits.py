"""SURVEY section 5 properties: applying a batch twice equals applying it once, and the
integrity audits stay empty after the apply jobs."""

import datetime as dt

from pyspark.sql import Row

from marquee.operators import allocate as AL
from marquee.operators import apply as AP
from marquee.operators import audits as Q
from marquee.operators import notices as N
from marquee.operators import seatmap as SM

T = dt.datetime(2025, 7, 1)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cancel_twice_is_cancel_once(spark, seed):
    reqs = spark.createDataFrame([(1, T, 4, 4, False)], "request_id long, requested_at timestamp_ntz, booking_id long, "
                                                        "actor_id long, actor_is_admin boolean")
    once, _ = AP.cancel_bookings(seed, reqs)
    twice, out2 = AP.cancel_bookings(once, reqs)
    assert [r.outcome for r in out2.collect()] == ["ALREADY_CANCELLED"]
    for t in ("bookings", "seats", "booking_seats", "payments", "booking_food"):
        assert _rows(once[t]) == _rows(twice[t]), t


def test_register_twice_is_register_once(spark, seed):
    reqs = spark.createDataFrame([(1, T, "A", "a@x.test"), (2, T, "B", "b@x.test")],
                                 "request_id long, requested_at timestamp_ntz, full_name string, email string")
    once, _ = AP.register_users(seed, reqs)
    twice, out2 = AP.register_users(once, reqs)
    assert {r.outcome for r in out2.collect()} == {"DUPLICATE"}
    assert _rows(once["users"]) == _rows(twice["users"])


def test_mark_reminded_and_refresh_are_idempotent(seed):
    due = N.reminders_due(seed, "2025-07-14")
    once = N.mark_reminded(seed, due)
    twice = N.mark_reminded({**seed, "bookings": once}, due)
    assert _rows(once) == _rows(twice)
    assert N.reminders_due({**seed, "bookings": once}, "2025-07-14").count() == 0
    a1 = SM.refresh_availability(seed)
    assert _rows(SM.refresh_availability({**seed, "seats": a1})) == _rows(a1)


def test_audits_empty_after_allocation_and_cancel(spark, seed):
    reqs = spark.createDataFrame(
        [(10, T, 2, 1, [4, 5], [Row(food_id=1, quantity=1)], None), (11, T, 3, 1, [5, 6], [], "Credit Card"),
         (12, T + dt.timedelta(minutes=1), 3, 5, [201, 202, 203], [], None)],
        "request_id long, requested_at timestamp_ntz, user_id long, show_id long, seat_ids array<bigint>, "
        "food array<struct<food_id:bigint,quantity:int>>, payment_method string")
    st, out = AL.allocate_seats(seed, reqs)
    assert {r.request_id: r.outcome for r in out.collect()} == {10: "ACCEPTED", 11: "CONFLICT", 12: "ACCEPTED"}
    cancel = spark.createDataFrame([(1, T + dt.timedelta(hours=1), 1, 1, False)],
                                   "request_id long, requested_at timestamp_ntz, booking_id long, actor_id long, "
                                   "actor_is_admin boolean")
    st, _ = AP.cancel_bookings(st, cancel)
    for audit in (Q.audit_unique, Q.audit_fk, Q.audit_check, Q.audit_not_null, Q.audit_domain,
                  Q.double_booked_seats, Q.availability_drift, Q.rating_drift):
        assert audit(st).count() == 0, audit.__name__
