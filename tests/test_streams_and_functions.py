"""Streams against their batch forms (including late rows), and column helpers."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from marquee.functions.numeric import half_up_ratio
from marquee.functions.text import format_inr, format_long_date, parse_seat_labels
from marquee.operators import notices as N
from marquee.plans.paging import page_window, paged, paged_after
from marquee.session import scratch_dir
from marquee.streaming import streams as TS

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def test_request_windows_drop_late_rows(spark):
    t = dt.datetime(2024, 1, 1, 0, 0)
    early = [(i, t + dt.timedelta(minutes=i), 1, "view", 0.0, "{}") for i in range(0, 60, 5)]
    late = [(100, t + dt.timedelta(minutes=1), 1, "signup", 0.0, "{}")]  # 1 hour behind: beyond the 10-minute watermark
    after = [(200 + i, t + dt.timedelta(minutes=70 + i), 2, "signup", 0.0, "{}") for i in range(0, 40, 5)]
    # Spark drops a row as late against the previous batch's watermark: deliver the late
    # row two micro-batches after the early rows (one file per trigger)
    src = scratch_dir(spark, "test-events")
    _events(spark, early).coalesce(1).write.parquet(src)
    _events(spark, after).coalesce(1).write.mode("append").parquet(src)
    _events(spark, late).coalesce(1).write.mode("append").parquet(src)
    stream = TS.file_stream(spark, src, _events(spark, early).schema)
    got = TS.stream_to_table(spark, TS.stream_request_windows(stream), "test-t3")
    batch = TS.request_windows_batch(_events(spark, early + after))
    wm_end = t + dt.timedelta(minutes=105) - dt.timedelta(minutes=10)
    want = {tuple(r) for r in batch.filter(F.col("window_end") <= F.lit(wm_end)).collect()}
    assert {tuple(r) for r in got.collect()} == want  # the late signup is not counted


def test_avg_rating_stream_in_batches_equals_batch(spark, seed):
    from marquee.operators.analytics import avg_rating
    path, files = TS.stage_stream_source(seed["reviews"], "reviewed_at", scratch_dir(spark, "test-reviews"), slices=2)
    running = TS.stream_to_table(spark, TS.stream_avg_rating(TS.file_stream(spark, path, seed["reviews"].schema, files)),
                                 "test-t2", mode="complete")
    got = {r.show_id: r.avg_rating for r in TS.avg_from_running(running).collect()}
    want = {r.show_id: r.avg_rating for r in avg_rating(seed).filter("review_count > 0").collect()}
    assert got == want == {1: D("4.50"), 2: D("4.00"), 3: D("5.00")}


def test_reminder_runs_are_idempotent(spark, seed):
    base = scratch_dir(spark, "test-reminders")
    first = TS.run_reminders(seed, "2025-07-14", base + "/log", base + "/outbox")
    second = TS.run_reminders(seed, "2025-07-14", base + "/log", base + "/outbox")
    assert sorted(r.booking_id for r in first.collect()) == [1, 4]
    assert second.count() == 0
    assert spark.read.parquet(base + "/log").count() == 2
    assert spark.read.parquet(base + "/outbox").count() == 2


def test_hold_expiry_stream_is_within_batch(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 1, "view", 0.0, "{}"), (2, t + dt.timedelta(minutes=3), 1, "purchase", 0.0, "{}"),
            (3, t + dt.timedelta(minutes=10), 2, "view", 0.0, "{}"), (4, t + dt.timedelta(minutes=30), 2, "purchase", 0.0, "{}"),
            (5, t + dt.timedelta(hours=3), 3, "view", 0.0, "{}"), (6, t + dt.timedelta(hours=3), 4, "purchase", 0.0, "{}")]
    src = scratch_dir(spark, "test-holds")
    _events(spark, rows).coalesce(1).write.parquet(src)
    s1 = TS.file_stream(spark, src, _events(spark, rows).schema)
    got = TS.stream_to_table(spark, TS.stream_hold_expiry(s1.filter("event_type = 'view'"), s1.filter("event_type = 'purchase'")), "test-t4")
    # both sides' watermarks (the global one is their minimum) pass hold 3's range; hold 5 is
    # still inside its range at the final watermark, so only the batch form reports it
    assert [r.hold_id for r in got.collect()] == [3]
    assert sorted(r.hold_id for r in TS.hold_expiry_batch(_events(spark, rows)).collect()) == [3, 5]


def test_outbox_messages_and_sink(spark, seed):
    msgs = N.outbox_messages(seed["users"], "welcome")
    m = msgs.filter("message_id = 'welcome:1'").first()
    assert m.subject.startswith("Welcome to ") and "<h2>Welcome, User 1!</h2>" in m.html
    path = scratch_dir(spark, "test-outbox")
    N.outbox_sink(msgs, path)
    N.outbox_sink(msgs, path)
    assert spark.read.parquet(path).count() == 6


def test_format_inr(spark):
    df = spark.createDataFrame([(D("1234567.5"),), (D("999"),), (D("100000"),), (D("-12345.678"),), (None,)],
                               "a decimal(20,3)")
    assert [r[0] for r in df.select(format_inr(F.col("a"))).collect()] == [
        "₹12,34,567.50", "₹999.00", "₹1,00,000.00", "-₹12,345.68", None]


def test_format_long_date(spark):
    df = spark.createDataFrame([(dt.date(2025, 7, 15),)], "d date")
    assert df.select(format_long_date(F.col("d"))).first()[0] == "Tuesday, 15 July 2025"


def test_parse_seat_labels(spark):
    df = spark.createDataFrame([(1, "A1, A2, C10")], "booking_id long, seat_labels string")
    got = [(r.pos, r.row_letter, r.seat_number) for r in parse_seat_labels(df).collect()]
    assert got == [(0, "A", 1), (1, "A", 2), (2, "C", 10)]


def test_half_up_is_exact(spark):
    # 8.35 is 8.3499999... as a double; the exact rule rounds 167/20 half up to 8.4
    df = spark.createDataFrame([(167, 20), (1, 3), (2, 3), (0, 0)], "n long, d long")
    got = [r[0] for r in df.select(half_up_ratio(F.col("n"), F.col("d"), 1)).collect()]
    assert got == [D("8.4"), D("0.3"), D("0.7"), None]


def test_paging(spark):
    assert page_window(None, None) == (0, 10)
    assert page_window("3", "500") == (100, 50)
    assert page_window(0, "x") == (0, 10)
    df = spark.range(0, 95).withColumnRenamed("id", "k")
    assert [r.k for r in paged(df, [F.col("k")], 2, 20).collect()] == list(range(20, 40))
    assert [r.k for r in paged_after(df, ["k"], (89,), 20).collect()] == list(range(90, 95))
