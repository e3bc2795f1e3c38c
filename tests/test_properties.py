"""Properties on random request logs over a tiny seed: the Spark jobs equal a plain
sequential Python replay written here, independently of the library."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row

from marquee.operators import allocate as AL
from marquee.operators import replay as RP
from marquee.streaming import streams as TS

BOOK_SCHEMA = ("request_id long, requested_at timestamp_ntz, user_id long, show_id long, seat_ids array<bigint>, "
               "food array<struct<food_id:bigint,quantity:int>>, payment_method string")
T0 = dt.datetime(2025, 7, 1)


def random_requests(rng, n, shows=(1, 5), same_time=False):
    reqs = []
    for i in range(1, n + 1):
        show = rng.choice(shows)
        base = (show - 1) * 50
        k = rng.randint(1, 3)
        seats = [base + rng.randint(1, 12) for _ in range(k)]
        if rng.random() < 0.1:
            seats.append(999)  # no such seat
        food = [(rng.choice([1, 2, 77]), 1)] if rng.random() < 0.3 else []
        ts = T0 if same_time else T0 + dt.timedelta(minutes=rng.randint(0, 50))
        reqs.append((i, ts, rng.randint(1, 5), show, seats, food))
    return reqs


def sequential_allocation(reqs, seats_of_show, unavailable, foods):
    """Plain replay in (requested_at, request_id) order."""
    taken = set(unavailable)
    out = {}
    for rid, ts, user, show, seat_ids, food in sorted(reqs, key=lambda r: (r[1], r[0])):
        if len(set(seat_ids)) != len(seat_ids) or any(s not in seats_of_show[show] for s in seat_ids):
            out[rid] = ("INVALID_SEAT", None)
        elif taken & set(seat_ids):
            out[rid] = ("CONFLICT", sorted(taken & set(seat_ids)))
        elif len({f for f, _ in food}) != len(food) or any(f not in foods for f, _ in food):
            out[rid] = ("INVALID_FOOD", None)
        else:
            taken |= set(seat_ids)
            out[rid] = ("ACCEPTED", None)
    return out


def _seed_facts(seed):
    seats = seed["seats"].select("seat_id", "show_id", "is_available").collect()
    by_show = {}
    for r in seats:
        by_show.setdefault(r.show_id, set()).add(r.seat_id)
    unavailable = {r.seat_id for r in seats if r.is_available == 0}
    foods = {r.food_id for r in seed["food_items"].collect()}
    return by_show, unavailable, foods


@pytest.mark.parametrize("seed_no,same_time", [(1, False), (2, False), (3, True)])
def test_allocation_equals_sequential(spark, seed, seed_no, same_time):
    rng = random.Random(seed_no)
    reqs = random_requests(rng, 40, same_time=same_time)
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], [Row(food_id=f, quantity=q) for f, q in r[5]], None)
                                for r in reqs], BOOK_SCHEMA)
    ns, out = AL.allocate_seats(seed, df)
    got = {r.request_id: (r.outcome, list(r.unavailable_seats) if r.unavailable_seats is not None else None)
           for r in out.collect()}
    want = sequential_allocation(reqs, *_seed_facts(seed))
    assert got == want
    # no seat is sold twice, accepted + rejected = requests
    lines = ns["booking_seats"].groupBy("seat_id").count().filter("count > 1").count()
    assert lines == 0
    assert len(got) == len(reqs)


# ---------------------------------------------------------------------------
# command-log replay (M16) and its stream form
# ---------------------------------------------------------------------------
def brute_force_replay(book, cancel, pay, seats_of_show, foods):
    """Independent sequential model of the book / cancel / payment handlers."""
    show_of = {r[0]: r[3] for r in book}
    cmds = ([("book", r[1], r[0], r) for r in book] + [("cancel", r[1], r[0], r) for r in cancel]
            + [("payment", r[1], r[0], r) for r in pay])
    cmds.sort(key=lambda c: (show_of.get(c[3][2] if c[0] != "book" else c[3][0], -1), c[1], c[2]))
    unavailable, bk, out = {}, {}, {}
    for kind, ts, cid, r in cmds:
        if kind == "book":
            rid, _, user, show, seats, food = r
            u = unavailable.setdefault(show, set())
            if len(set(seats)) != len(seats) or any(s not in seats_of_show[show] for s in seats):
                out[cid] = "INVALID_SEAT"
            elif u & set(seats):
                out[cid] = "CONFLICT"
            elif any(f not in foods for f, _ in food) or len({f for f, _ in food}) != len(food):
                out[cid] = "INVALID_FOOD"
            else:
                u |= set(seats)
                bk[rid] = dict(owner=user, status="CONFIRMED", seats=list(seats), paid=True, show=show)
                out[cid] = "ACCEPTED"
            continue
        b = bk.get(r[2])
        actor, admin = r[3], r[4]
        if kind == "cancel":
            if b is None:
                out[cid] = "NOT_FOUND"
            elif b["owner"] != actor and not admin:
                out[cid] = "FORBIDDEN"
            elif b["status"] == "CANCELLED":
                out[cid] = "ALREADY_CANCELLED"
            else:
                unavailable[b["show"]] -= set(b["seats"])
                b.update(status="CANCELLED", seats=[], paid=False)
                out[cid] = "CANCELLED"
        else:
            status = r[5]
            if status not in ("SUCCESS", "FAILED"):
                out[cid] = "INVALID_STATUS"
            elif b is None or not b["paid"]:
                out[cid] = "NOT_FOUND"
            elif b["owner"] != actor and not admin:
                out[cid] = "FORBIDDEN"
            else:
                if status == "FAILED":
                    unavailable[b["show"]] -= set(b["seats"])
                    b["status"] = "CANCELLED"
                else:
                    b["status"] = "CONFIRMED"
                out[cid] = "APPLIED"
    return out


def random_log(rng, n_book=30):
    book = []
    for i in range(1, n_book + 1):
        show = rng.choice([1, 2])
        seats = [50 * (show - 1) + rng.randint(1, 8) for _ in range(rng.randint(1, 2))]
        book.append((i, T0 + dt.timedelta(minutes=10 * i + rng.randint(0, 5)), rng.randint(1, 4), show, seats, []))
    cancel, pay = [], []
    for b in book:
        if rng.random() < 0.3:
            actor = b[2] if rng.random() < 0.8 else b[2] + 1
            cancel.append((1000 + b[0], b[1] + dt.timedelta(minutes=rng.randint(1, 40)), b[0], actor, actor == 1))
        if rng.random() < 0.4:
            st = rng.choice(["SUCCESS", "FAILED", "FAILED", "BOGUS"])
            pay.append((2000 + b[0], b[1] + dt.timedelta(minutes=rng.randint(1, 40)), b[0], b[2], False, st, None))
    cancel.append((3000, T0, 424242, 1, True))  # unknown booking
    return book, cancel, pay


def _log_frames(spark, book, cancel, pay):
    b = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], [], None) for r in book], BOOK_SCHEMA)
    c = spark.createDataFrame(cancel, "request_id long, requested_at timestamp_ntz, booking_id long, actor_id long, "
                                      "actor_is_admin boolean")
    p = spark.createDataFrame(pay, "request_id long, requested_at timestamp_ntz, booking_id long, actor_id long, "
                                   "actor_is_admin boolean, payment_status string, payment_method string")
    return b, c, p


@pytest.fixture()
def fresh_seed(seed):
    from pyspark.sql import functions as F
    st = {k: (v.filter(F.lit(False)) if k in ("bookings", "booking_seats", "booking_food", "payments", "reviews") else v)
          for k, v in seed.items()}
    st["seats"] = seed["seats"].withColumn("is_available", F.lit(1))
    return st


@pytest.mark.parametrize("seed_no", [7, 8])
def test_replay_equals_brute_force(spark, fresh_seed, seed_no):
    rng = random.Random(seed_no)
    book, cancel, pay = random_log(rng)
    log = RP.command_log(fresh_seed, *_log_frames(spark, book, cancel, pay))
    got = {r.cmd_id: r.outcome for r in RP.replay_booking_log(log).collect()}
    by_show, _, foods = _seed_facts(fresh_seed)
    assert got == brute_force_replay(book, cancel, pay, by_show, foods)


def test_stream_in_batches_equals_batch_replay(spark, fresh_seed):
    rng = random.Random(11)
    book, cancel, pay = random_log(rng)
    log = RP.command_log(fresh_seed, *_log_frames(spark, book, cancel, pay))
    batch = {r.cmd_id: r.outcome for r in RP.replay_booking_log(log).filter("show_id is not null").collect()}
    from marquee.session import scratch_dir
    path, files = TS.stage_stream_source(log, "ts", scratch_dir(spark, "test-log"), slices=3)
    streamed = TS.stream_to_table(spark, TS.stream_seat_state(TS.file_stream(spark, path, log.schema, files)), "test-t1")
    assert {r.cmd_id: r.outcome for r in streamed.collect()} == batch


@pytest.mark.parametrize("seed_no,slices", [(11, 3), (12, 5)])
def test_seat_upkeep_in_batches_equals_batch_replay(spark, fresh_seed, seed_no, slices):
    from marquee.session import scratch_dir
    book, cancel, pay = random_log(random.Random(seed_no))
    log = RP.command_log(fresh_seed, *_log_frames(spark, book, cancel, pay))
    batch = RP.replay_booking_log(log).filter("show_id is not null")
    path, files = TS.stage_stream_source(log, "ts", scratch_dir(spark, "test-log"), slices=slices, files_per_slice=1)
    outcomes, seats = TS.stream_seat_upkeep(spark, TS.file_stream(spark, path, log.schema, files), scratch_dir(spark, "test-t1"))
    assert sorted(map(str, outcomes.collect())) == sorted(map(str, batch.collect()))
    want = {r.seat_id: r.is_available for r in RP.final_seats(log, batch).collect()}
    got = seats.collect()
    assert {r.seat_id: r.is_available for r in got} == want and len(got) == len(want) and set(want.values()) == {0, 1}
    assert all(r.show_id == (r.seat_id - 1) // 50 + 1 for r in got)
