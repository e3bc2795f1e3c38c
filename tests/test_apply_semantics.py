"""Semantics of the apply jobs on the seed: check order, first/last wins, patches, ids."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from marquee.operators import apply as AP
from marquee.operators import validate as V
from marquee.plans.ids import assign_ids

T = dt.datetime(2025, 7, 1)


def test_register_users_duplicates_ignore_case(spark, seed):
    reqs = spark.createDataFrame(
        [(1, T, "A", "new@x.test"), (2, T + dt.timedelta(minutes=1), "B", "NEW@X.TEST"),
         (3, T, "C", "USER1@example.test"), (4, T, "", "ok@x.test"), (5, T, "E", "not-an-email")],
        "request_id long, requested_at timestamp_ntz, full_name string, email string")
    ns, out = AP.register_users(seed, reqs)
    got = {r.request_id: (r.outcome, r.user_id) for r in out.collect()}
    assert got == {1: ("ACCEPTED", 7), 2: ("DUPLICATE", None), 3: ("DUPLICATE", None),
                   4: ("INVALID", None), 5: ("INVALID", None)}
    assert ns["users"].count() == 7


def test_payment_results_last_wins_and_method(spark, seed):
    reqs = spark.createDataFrame(
        [(1, T, 2, 2, False, "FAILED", "Net Banking"), (2, T + dt.timedelta(hours=1), 2, 2, False, "SUCCESS", None),
         (3, T, 3, 9, False, "SUCCESS", None), (4, T, 99, 1, True, "SUCCESS", None), (5, T, 1, 1, False, "REFUNDED", None)],
        "request_id long, requested_at timestamp_ntz, booking_id long, actor_id long, actor_is_admin boolean, "
        "payment_status string, payment_method string")
    ns, out = AP.apply_payment_results(seed, reqs)
    assert {r.request_id: r.outcome for r in out.collect()} == {
        1: "APPLIED", 2: "APPLIED", 3: "FORBIDDEN", 4: "NOT_FOUND", 5: "INVALID_STATUS"}
    p = ns["payments"].filter("booking_id = 2").first()
    assert (p.payment_status, p.payment_method, p.paid_at) == ("SUCCESS", "Net Banking", T + dt.timedelta(hours=1))
    assert ns["bookings"].filter("booking_id = 2").first().booking_status == "CONFIRMED"
    # FAILED then SUCCESS: the seats were freed and are not claimed again (double sale possible)
    assert ns["seats"].filter("seat_id between 51 and 54 and is_available = 1").count() == 4


def test_cancel_check_order(spark, seed):
    reqs = spark.createDataFrame(
        [(1, T, 1, 2, False), (2, T, 1, 1, False), (3, T + dt.timedelta(minutes=1), 1, 6, True), (4, T, 77, 1, True)],
        "request_id long, requested_at timestamp_ntz, booking_id long, actor_id long, actor_is_admin boolean")
    ns, out = AP.cancel_bookings(seed, reqs)
    assert {r.request_id: r.outcome for r in out.collect()} == {
        1: "FORBIDDEN", 2: "CANCELLED", 3: "ALREADY_CANCELLED", 4: "NOT_FOUND"}
    assert ns["payments"].filter("booking_id = 1").count() == 0
    assert ns["booking_seats"].filter("booking_id = 1").count() == 0
    assert ns["bookings"].filter("booking_id = 1").first().total_amount == D("2400.00")


def test_update_shows_patch_semantics(spark, seed):
    reqs = spark.createDataFrame(
        [(1, T, 1, {"title": "First", "base_price": "10.50"}), (2, T + dt.timedelta(minutes=1), 1, {"title": "Second"}),
         (3, T, 2, {"description": None}), (4, T, 3, {"unknown": "x"}), (5, T, 999, {"title": "ghost"})],
        "request_id long, requested_at timestamp_ntz, show_id long, patch map<string,string>")
    ns, out = AP.update_shows(seed, reqs)
    assert {r.request_id: r.outcome for r in out.collect()} == {
        1: "UPDATED", 2: "UPDATED", 3: "UPDATED", 4: "NO_FIELDS", 5: "UPDATED"}
    s = {r.show_id: r for r in ns["shows"].collect()}
    assert (s[1].title, s[1].base_price) == ("Second", D("10.50"))  # per field, the last present value wins
    assert s[2].description is None and s[3].title == "Show 3"
    assert ns["shows"].count() == 5


def test_delete_reviews_and_refresh(spark, seed):
    reqs = spark.createDataFrame([(1, T, 1, 1, False), (2, T, 4, 2, False), (3, T, 2, 6, True)],
                                 "request_id long, requested_at timestamp_ntz, review_id long, actor_id long, "
                                 "actor_is_admin boolean")
    ns, out = AP.delete_reviews(seed, reqs)
    assert {r.request_id: r.outcome for r in out.collect()} == {1: "DELETED", 2: "FORBIDDEN", 3: "DELETED"}
    ratings = {r.show_id: r.avg_rating for r in ns["shows"].collect()}
    assert ratings[1] == D("4.00") and ratings[2] == D("0.00")


def test_assign_ids_dense_in_order(spark):
    df = spark.range(0, 1000).select((1000 - F.col("id")).alias("request_id"),
                                     F.lit(T).cast("timestamp_ntz").alias("requested_at"))
    out = assign_ids(df, ["requested_at", "request_id"], 41, "new_id", partitions=7)
    got = sorted((r.request_id, r.new_id) for r in out.collect())
    assert got == [(rid, 41 + i + 1) for i, rid in enumerate(range(1, 1001))]


def test_validate_split(spark):
    df = spark.createDataFrame([(1, 0, [1, 2]), (2, 3, []), (3, 3, [0]), (4, 3, [5])],
                               "request_id long, show_id long, seat_ids array<bigint>")
    ok, bad = V.split_valid(df, "booking")
    assert [r.request_id for r in ok.collect()] == [4]
    errs = {r.request_id: list(r.errors) for r in bad.collect()}
    assert errs == {1: ["event_id must be a positive integer"], 2: ["seat_ids must be a non-empty array"],
                    3: ["Each seat_id must be a positive integer"]}


# --- ids, chains, unknown actors, refused patches -----------------------------
def test_generated_maps_keep_ids_unique(spark, seed):
    from marquee.operators import audits as Q
    from marquee.operators import seatmap as SM
    spec = spark.createDataFrame([(1, 30, 150, 1, 1, None, None, None), (2, 26, 120, 1, 1, None, None, None)],
                                 "show_id long, n_rows int, seats_per_row int, vip_rows int, premium_rows int, "
                                 "vip_price decimal(10,2), premium_price decimal(10,2), regular_price decimal(10,2)")
    seats, _ = SM.generate_seat_map(seed, spec)
    assert seats.count() == 26 * 150 + 26 * 120 + 150
    assert seats.select("seat_id").distinct().count() == seats.count()
    state = dict(seed, seats=seats)
    assert Q.audit_unique(state).count() == 0
    old = {r.seat_id for r in seed["seats"].filter("show_id > 2").collect()}
    assert {r.seat_id for r in seats.filter("show_id > 2").collect()} == old


def test_line_ids_of_seats_a_thousand_apart(spark, seed):
    from marquee.operators import allocate as AL
    more = seed["seats"].limit(1).withColumn("seat_id", F.lit(1006).cast("long")).withColumn("row_letter", F.lit("Z"))
    state = dict(seed, seats=seed["seats"].unionByName(more.withColumn("is_available", F.lit(1)).withColumn("show_id", F.lit(1).cast("long"))))
    reqs = spark.createDataFrame([(1, dt.datetime(2025, 7, 1), 1, 1, [6, 1006], [], None)],
                                 "request_id long, requested_at timestamp_ntz, user_id long, show_id long, seat_ids array<bigint>, "
                                 "food array<struct<food_id:bigint,quantity:int>>, payment_method string")
    ns, out = AL.allocate_seats(state, reqs)
    assert [r.outcome for r in out.collect()] == ["ACCEPTED"]
    for table, key in (("booking_seats", "bs_id"), ("booking_food", "bf_id"), ("payments", "payment_id")):
        assert ns[table].select(key).distinct().count() == ns[table].count()


def test_chain_of_conflicts_in_few_rounds(spark, seed):
    """Request i wants seats i and i + 1: the sequential answer accepts every other one."""
    from marquee.operators import allocate as AL
    n = 500
    rows = [(10_000 + i, 1, "A", i, "VIP", 1, D("10.00")) for i in range(n + 2)]
    state = dict(seed, seats=spark.createDataFrame(rows, seed["seats"].schema))
    reqs = spark.createDataFrame([(i, dt.datetime(2025, 7, 1) + dt.timedelta(seconds=i), 1, 1, [10_000 + i, 10_001 + i], [], None) for i in range(n)],
                                 "request_id long, requested_at timestamp_ntz, user_id long, show_id long, seat_ids array<bigint>, "
                                 "food array<struct<food_id:bigint,quantity:int>>, payment_method string")
    _, out, rounds = AL.allocate_seats(state, reqs, return_rounds=True)
    assert {r.request_id: r.outcome for r in out.collect()} == {i: "ACCEPTED" if i % 2 == 0 else "CONFLICT" for i in range(n)}
    assert rounds <= AL.SET_ROUNDS + 1


def test_unknown_actor_owns_nothing(spark, seed):
    pay = spark.createDataFrame([(1, dt.datetime(2025, 7, 1), 1, None, None, "FAILED", None), (2, dt.datetime(2025, 7, 1), 1, None, True, "SUCCESS", None)],
                                "request_id long, requested_at timestamp_ntz, booking_id long, actor_id long, actor_is_admin boolean, "
                                "payment_status string, payment_method string")
    assert [r.outcome for r in AP.apply_payment_results(seed, pay)[1].orderBy("request_id").collect()] == ["FORBIDDEN", "APPLIED"]
    upd = spark.createDataFrame([(1, dt.datetime(2025, 7, 1), 1, None, 3, "x")],
                                "request_id long, requested_at timestamp_ntz, review_id long, actor_id long, rating int, comment string")
    ns, out = AP.update_reviews(seed, upd)
    assert [r.outcome for r in out.collect()] == ["FORBIDDEN"]
    assert ns["reviews"].filter("review_id = 1").first().rating == 5


def test_refused_patches_change_nothing(spark, seed):
    patches = [(1, {"base_price": "abc", "title": "New"}), (2, {"venue_id": "999999"}), (3, {"title": None}), (4, {"base_price": "-1"}),
               (5, {"description": None, "base_price": "7.5"}), (99, {"base_price": "abc"}), (1, {}), (2, {"colour": "red"}), (3, {"show_date": "soon"})]
    df = spark.createDataFrame([(k, dt.datetime(2025, 7, 1), s, p) for k, (s, p) in enumerate(patches)],
                               "request_id long, requested_at timestamp_ntz, show_id long, patch map<string,string>")
    ns, out = AP.update_shows(seed, df)
    assert [r.outcome for r in out.orderBy("request_id").collect()] == [
        "INVALID", "INVALID_REFERENCE", "INVALID", "INVALID", "UPDATED", "UPDATED", "NO_FIELDS", "NO_FIELDS", "INVALID"]
    before, after = ({r.show_id: r for r in s["shows"].collect()} for s in (seed, ns))
    assert all(before[k] == after[k] for k in range(1, 5)) and after[5].base_price == D("7.50")


def test_short_password_is_invalid(spark, seed):
    reqs = spark.createDataFrame([(1, dt.datetime(2025, 7, 1), "A", "a@x.test", 5), (2, dt.datetime(2025, 7, 1), "B", "b@x.test", 6), (3, dt.datetime(2025, 7, 1), "C", "c@x.test", None)],
                                 "request_id long, requested_at timestamp_ntz, full_name string, email string, password_length int")
    assert [r.outcome for r in AP.register_users(seed, reqs)[1].orderBy("request_id").collect()] == ["INVALID", "ACCEPTED", "INVALID"]


def test_outbox_sink_drops_repeats(spark, seed, tmp_path):
    from marquee.operators import notices as N
    msgs = N.outbox_messages(seed["users"], "welcome")
    N.outbox_sink(msgs.unionByName(msgs), str(tmp_path / "box"))
    N.outbox_sink(msgs, str(tmp_path / "box"))
    assert spark.read.parquet(str(tmp_path / "box")).count() == seed["users"].count()
