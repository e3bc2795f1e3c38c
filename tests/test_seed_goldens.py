"""Golden values derived by hand from the seed (FIXTURES.md section 2)."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import Row
from pyspark.sql import functions as F

from marquee.operators import allocate as AL
from marquee.operators import analytics as A
from marquee.operators import apply as AP
from marquee.operators import audits as Q
from marquee.operators import documents as DOC
from marquee.operators import listings as L
from marquee.operators import notices as N
from marquee.operators import seatmap as SM


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_dashboard_overview(seed):
    r = A.dashboard_overview(seed).first()
    assert (r.total_users, r.total_events, r.total_bookings, r.total_revenue) == (6, 5, 5, D("10600.00"))


def test_view_event_revenue(seed):
    got = {r.show_id: (r.total_bookings, r.total_revenue, r.avg_rating) for r in A.view_event_revenue(seed).collect()}
    assert got == {1: (2, D("3400.00"), D("4.50")), 2: (1, D("1600.00"), D("4.00")), 3: (1, D("3600.00"), D("5.00")),
                   4: (1, D("2000.00"), D("0.00")), 5: (0, D("0.00"), D("0.00"))}


def test_revenue_by_event_order(seed):
    assert rows(A.revenue_by_event(seed), "show_id") == [(3,), (1,), (4,), (2,)]


def test_top_rated_events(seed):
    assert rows(A.top_rated_events(seed), "show_id", "review_count") == [(3, 1), (1, 2), (2, 1), (4, 0), (5, 0)]


def test_available_seats(seed):
    got = {(r.show_id, r.seat_type): r.available_count for r in L.view_available_seats(seed).collect()}
    want = {1: (7, 10, 28), 2: (6, 10, 30), 3: (7, 10, 30), 4: (5, 10, 30), 5: (10, 10, 30)}
    for s, (v, p, g) in want.items():
        assert (got[(s, "VIP")], got[(s, "PREMIUM")], got[(s, "REGULAR")]) == (v, p, g)
    assert sum(got.values()) == 233


def test_rating_distribution(seed):
    d = A.rating_distribution(seed).filter("show_id = 1")
    assert rows(d, "rating", "count", "percentage") == [
        (5, 1, D("50.0")), (4, 1, D("50.0")), (3, 0, D("0.0")), (2, 0, D("0.0")), (1, 0, D("0.0"))]


def test_booking_cost_and_drift(seed):
    got = {r.booking_id: (r.seat_total, r.food_total, r.total_cost) for r in DOC.booking_cost(seed).collect()}
    assert got == {1: (D("3600.00"), D("250.00"), D("3850.00")), 2: (D("3200.00"), D("600.00"), D("3800.00")),
                   3: (D("5400.00"), D("270.00"), D("5670.00")), 4: (D("1000.00"), D("90.00"), D("1090.00")),
                   5: (D("5000.00"), D("120.00"), D("5120.00"))}
    assert sorted(r.booking_id for r in Q.cost_drift(seed).collect()) == [1, 2, 3, 4, 5]


def test_seat_labels(seed):
    got = {r.booking_id: r.seat_labels for r in DOC.seat_labels(seed).collect()}
    assert got == {1: "A1, A2, A3", 2: "A1, A2, A3, A4", 3: "A1, A2, A3", 4: "C1, C2", 5: "A1, A2, A3, A4, A5"}


def test_reminders_and_review_requests(seed):
    assert sorted(r.booking_id for r in N.reminders_due(seed, "2025-07-14").collect()) == [1, 4]
    assert [r.booking_id for r in N.review_requests_due(seed, "2025-09-06").collect()] == [5]
    assert N.review_requests_due(seed, "2025-07-16").count() == 0


def test_cancel_booking_4(spark, seed):
    req = spark.createDataFrame([(1, dt.datetime(2025, 7, 1), 4, 4, False)],
                                "request_id long, requested_at timestamp_ntz, booking_id long, actor_id long, actor_is_admin boolean")
    ns, out = AP.cancel_bookings(seed, req)
    assert out.first().outcome == "CANCELLED"
    free = {r.seat_id: r.is_available for r in ns["seats"].filter("seat_id in (21, 22)").collect()}
    assert free == {21: 1, 22: 1}
    rev = {r.show_id: (r.total_bookings, r.total_revenue) for r in A.view_event_revenue(ns).collect()}
    assert rev[1] == (1, D("2400.00"))
    assert A.dashboard_overview(ns).first().total_revenue == D("9600.00")


def test_payment_failed_for_5(spark, seed):
    req = spark.createDataFrame([(1, dt.datetime(2025, 7, 1), 5, 5, False, "FAILED", None)],
                                "request_id long, requested_at timestamp_ntz, booking_id long, actor_id long, "
                                "actor_is_admin boolean, payment_status string, payment_method string")
    ns, out = AP.apply_payment_results(seed, req)
    assert out.first().outcome == "APPLIED"
    assert ns["bookings"].filter("booking_id = 5").first().booking_status == "CANCELLED"
    assert ns["seats"].filter("seat_id between 151 and 155 and is_available = 1").count() == 5
    assert ns["booking_seats"].filter("booking_id = 5").count() == 5
    assert ns["payments"].filter("booking_id = 5").first().paid_at is None


def _book(spark, reqs):
    return spark.createDataFrame(
        [(i, dt.datetime(2025, 7, 1, 0, i), 2, show, seats, [Row(food_id=f, quantity=q) for f, q in food], None)
         for i, (show, seats, food) in enumerate(reqs, start=1)],
        "request_id long, requested_at timestamp_ntz, user_id long, show_id long, seat_ids array<bigint>, "
        "food array<struct<food_id:bigint,quantity:int>>, payment_method string")


def test_allocation_goldens(spark, seed):
    ns, out = AL.allocate_seats(seed, _book(spark, [(1, [4, 5], [(1, 1)])]))
    r = out.first()
    assert (r.outcome, r.total_amount) == ("ACCEPTED", D("2480.00"))
    assert ns["bookings"].filter(F.col("booking_id") == r.booking_id).first().booking_status == "CONFIRMED"
    ns, out = AL.allocate_seats(seed, _book(spark, [(1, [3, 4], [])]))
    r = out.first()
    assert (r.outcome, list(r.unavailable_seats)) == ("CONFLICT", [3])
    assert ns["seats"].filter("seat_id = 4").first().is_available == 1
    _, out = AL.allocate_seats(seed, _book(spark, [(1, [51], []), (1, [4, 4], [])]))
    assert [r.outcome for r in out.orderBy("request_id").collect()] == ["INVALID_SEAT", "INVALID_SEAT"]


def test_allocation_is_not_first_per_seat(spark, seed):
    # {A,B}, {B,C}, {C}: accepted, rejected, accepted
    _, out = AL.allocate_seats(seed, _book(spark, [(5, [201, 202], []), (5, [202, 203], []), (5, [203], [])]))
    assert [r.outcome for r in out.orderBy("request_id").collect()] == ["ACCEPTED", "CONFLICT", "ACCEPTED"]


def test_reviews(spark, seed):
    req = spark.createDataFrame(
        [(1, dt.datetime(2025, 9, 10), 1, 1, 5, ""), (2, dt.datetime(2025, 9, 10), 1, 2, 4, "ok"),
         (3, dt.datetime(2025, 9, 10), 2, 2, 6, "x")],
        "request_id long, requested_at timestamp_ntz, user_id long, show_id long, rating int, comment string")
    _, out = AP.submit_reviews(seed, req)
    assert [r.outcome for r in out.orderBy("request_id").collect()] == ["DUPLICATE", "FORBIDDEN", "INVALID"]


def test_generate_seat_map(spark, seed):
    spec = spark.createDataFrame([(1, 30, 2, 1, 1, None, None, None)],
                                 "show_id long, n_rows int, seats_per_row int, vip_rows int, premium_rows int, "
                                 "vip_price decimal(10,2), premium_price decimal(10,2), regular_price decimal(10,2)")
    seats, out = SM.generate_seat_map(seed, spec)
    s1 = seats.filter("show_id = 1")
    assert s1.count() == 52
    assert s1.select("row_letter").distinct().count() == 26
    assert {r.seat_type: r["count"] for r in s1.groupBy("seat_type").count().collect()} == {"VIP": 2, "PREMIUM": 2, "REGULAR": 48}
    assert seats.filter("show_id = 2").count() == 50  # other shows keep their seats


def test_seat_map_summary(seed):
    m = {r.show_id: r for r in SM.seat_map(seed).collect()}
    assert (m[1].total, m[1].available, m[1].booked) == (50, 45, 5)
    assert [s.seat_number for s in m[1].rows["A"]] == list(range(1, 11))


def test_audits_clean_seed(seed):
    for audit in (Q.audit_unique, Q.audit_fk, Q.audit_check, Q.audit_not_null, Q.audit_domain,
                  Q.double_booked_seats, Q.rating_drift, Q.availability_drift):
        assert audit(seed).count() == 0, audit.__name__


def test_audits_find_violations(spark, seed):
    bad = dict(seed)
    bad["reviews"] = seed["reviews"].unionByName(seed["reviews"].limit(1).withColumn("rating", F.lit(9)))
    found = {r.rule for r in Q.audit_unique(bad).collect()} | {r.rule for r in Q.audit_check(bad).collect()}
    assert "primary_key(review_id)" in found and "unique(user_id,show_id)" in found
    assert "check(rating between 1 and 5)" in found
    orphan = dict(seed)
    orphan["booking_seats"] = seed["booking_seats"].unionByName(
        spark.createDataFrame([(9999, 1, 99999)], "bs_id long, booking_id long, seat_id long"))
    assert [r.rule for r in Q.audit_fk(orphan).collect()] == ["fk(seat_id->seats)"]


def test_show_listing_filters(seed):
    assert L.show_listing(seed, search="SHOW 1").count() == 1  # case-insensitive LIKE
    assert L.show_listing(seed, search="Show _").count() == 5  # '_' stays a wildcard
    assert L.show_listing(seed, city="city a").count() == 4
    assert L.show_listing(seed, date_from="2025-08-10", date_to="2025-09-05").count() == 3
    assert L.show_listing(seed, category_id="").count() == 5  # empty parameter adds no predicate
