"""S5 at size: only seats that lines name are moved, documents are made slice by slice and packed."""

import datetime as dt
import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from marquee.operators import documents as DOC
from marquee.plans.lineage import CLEANUP
from marquee.session import scratch_dir

NO_TIME = dt.datetime(2001, 1, 1)


def seat(i, show):
    return (i, show, "A", 1, "VIP", 1, D("10.00"))


@pytest.fixture()
def st(spark):
    """Seats named by lines of their own show, of another show and of no known booking; ids that come twice, in one show and in two."""
    seats = [seat(s * 100 + k, s) for s in range(20) for k in range(70)] + [seat(305, 3), seat(306, 9), seat(307, None), seat(None, 4), seat(None, None), seat(-5, 2)]
    lines = [(1, 301), (1, 302), (1, 305), (2, 306), (2, 307), (2, 1950), (3, 410), (3, 410), (4, 1101), (99, 1203), (None, 1204), (1, None), (5, 99999), (6, -5)]
    books = [(1, 7, 3), (2, 7, 3), (3, 8, 4), (4, 8, None), (5, 9, 5), (6, 9, 6), (3, 8, 4), (None, 9, 7), (8, None, 8)]
    return {
        "seats": spark.createDataFrame(seats, "seat_id long, show_id long, row_letter string, seat_number int, seat_type string, is_available int, price decimal(10,2)").repartition(4, "show_id").hint("merge"),
        "booking_seats": spark.createDataFrame([(k, *r) for k, r in enumerate(lines)], "bs_id long, booking_id long, seat_id long"),
        "bookings": spark.createDataFrame([(b, u, s, NO_TIME, D("5.00"), "CONFIRMED", 0) for b, u, s in books],
                                          "booking_id long, user_id long, show_id long, booking_date timestamp_ntz, total_amount decimal(10,2), booking_status string, reminder_sent int"),
        "payments": spark.createDataFrame([(1, 1, D("5.00"), "UPI", "SUCCESS", NO_TIME), (2, 3, D("5.00"), None, "FAILED", None)],
                                          "payment_id long, booking_id long, amount decimal(10,2), payment_method string, payment_status string, paid_at timestamp_ntz"),
        "booking_food": spark.createDataFrame([(1, 1, 1, 2), (2, 1, 2, 1), (3, 3, 1, 1)], "bf_id long, booking_id long, food_id long, quantity int"),
        "food_items": spark.createDataFrame([(1, "f1", D("3.00"), 1), (2, "f2", D("4.00"), 0)], "food_id long, food_name string, price decimal(8,2), is_veg int"),
        "shows": spark.createDataFrame([(s, f"T{s}", dt.date(2001, 1, 2), "18:00:00", 1) for s in range(20)], "show_id long, title string, show_date date, show_time string, venue_id long"),
        "venues": spark.createDataFrame([(1, "V", "C")], "venue_id long, venue_name string, city string"),
    }


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("sent", [200_000, 0])
def test_every_seat_that_a_line_names_is_kept(spark, st, monkeypatch, sent):
    monkeypatch.setattr(DOC, "SENT_BLOCKS", sent)
    held = DOC.held_seats(st)
    want = rows(DOC.booking_seat_lines(st))
    assert rows(DOC.booking_seat_lines({**st, "seats": held})) == want and len(want) == 15
    assert held.count() < 40


def test_seats_stay_where_their_shows_are(spark, st):
    st["booking_seats"] = st["booking_seats"].filter("booking_id in (1, 3)")
    plan = DOC.held_seats(st)._jdf.queryExecution().executedPlan().toString()
    assert not any("seat_id" in line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_documents_are_whole_in_any_number_of_slices(spark, st, monkeypatch):
    monkeypatch.setattr(DOC, "SLICE", 2)
    whole = DOC.booking_documents(st)
    want = sorted(r[0] for r in whole.select(F.to_json(F.struct(*whole.columns), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"})).collect())
    path = scratch_dir(spark, "documents")
    before = set(os.listdir(os.path.dirname(path).removeprefix("file:"))) if os.path.exists(os.path.dirname(path).removeprefix("file:")) else set()
    counts = DOC.sink_booking_documents(st, path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == want and len(want) == 8
    assert {r.user_id: r["count"] for r in counts.collect()} == {7: 2, 8: 2, 9: 3, None: 1}
    files = [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]
    assert files and all(f.endswith(".json.gz") for f in files)
    left = set(os.listdir(os.path.dirname(path).removeprefix("file:"))) - before
    assert not any(f.startswith("document-parts") for f in left) and spark.conf.get(CLEANUP) == "false"
