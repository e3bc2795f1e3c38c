"""Streams with keyed state against plain Python: any split into batches, restarts, timers, touched buckets."""

import datetime as dt
import os
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from marquee.operators import notices as N
from marquee.operators.replay import COMMAND_SCHEMA, replay_booking_log
from marquee.plans.buckets import BucketTable
from marquee.session import scratch_dir
from marquee.streaming import keyed as K
from marquee.streaming import streams as TS

T0 = dt.datetime(2024, 1, 1)
STATUS = "booking_id long, show_id long, total_amount decimal(10,2), booking_status string, changed_at timestamp_ntz, change_id long"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def files(spark, path, batches, schema):
    """One file per batch, read one per trigger in this order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return TS.file_stream(spark, path, spark.createDataFrame([], schema).schema)


def cut(rng, rows, n):
    ends = sorted(rng.sample(range(1, len(rows)), n - 1))
    return [rows[a:b] for a, b in zip([0, *ends], [*ends, len(rows)])]


def revenue(rows):
    last = {}
    for b, show, amount, status, at, cid in rows:
        if b is not None and show is not None and (b not in last or (at, cid) > last[b][0]):
            last[b] = ((at, cid), show, amount or D(0), status)
    out = {}
    for _, show, amount, status in last.values():
        if status == "CONFIRMED":
            r = out.setdefault(show, [D(0), 0])
            r[0] += amount
            r[1] += 1
    return {k: (v, n) for k, (v, n) in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_revenue_follows_changes_in_any_split(spark, seed):
    rng = random.Random(seed)
    rows = []
    for b in range(40):
        at = T0 + dt.timedelta(minutes=rng.randrange(600))
        for k in range(rng.randrange(1, 6)):  # book, cancel, confirm again, move to another show, repeat
            rows.append((b, b % 5 if rng.random() < 0.9 else 9, D(rng.randrange(1, 9000)) / 100 if rng.random() < 0.9 else None, rng.choice(["CONFIRMED", "CONFIRMED", "CANCELLED", "PENDING", None]),
                         at + dt.timedelta(minutes=k // 2), len(rows)))
    rows += [rows[0], rows[3], (None, 1, D(5), "CONFIRMED", T0, 900), (77, None, D(5), "CONFIRMED", T0, 901)]
    rng.shuffle(rows)  # batches bring them in any order
    got = K.stream_revenue_changes(spark, files(spark, scratch_dir(spark, "changes"), cut(rng, rows, 4), STATUS), scratch_dir(spark, "revenue"))
    assert {r.show_id: (r.revenue, r.bookings) for r in got.collect()} == revenue(rows)


def test_cancelled_revenue_is_taken_back_after_a_restart(spark):
    src, root = scratch_dir(spark, "changes"), scratch_dir(spark, "revenue")
    book, cancel, again = [(1, 7, D("10.00"), s, T0 + dt.timedelta(hours=h), h) for h, s in enumerate(["CONFIRMED", "CANCELLED", "CONFIRMED"])]
    for rows, want in (([book, (2, 8, D("3.00"), "CONFIRMED", T0, 5)], {7: (D("10.00"), 1), 8: (D("3.00"), 1)}), ([cancel], {8: (D("3.00"), 1)}), ([again, again], {7: (D("10.00"), 1), 8: (D("3.00"), 1)})):
        stream = files(spark, src, [rows], STATUS)
        assert {r.show_id: (r.revenue, r.bookings) for r in K.stream_revenue_changes(spark, stream, root).collect()} == want


def windows(rows, end, minutes=15):
    """Windows closed before ``end`` by a walk over each client's requests in order."""
    out, length = [], dt.timedelta(minutes=minutes)
    keys = {}
    for _, ts, user, kind, *_ in rows:
        if user is not None:
            for scope in ("api", "auth") if kind == "signup" else ("api",):
                keys.setdefault((user, scope), []).append(ts)
    for (user, scope), times in keys.items():
        start, n = None, 0
        for ts in [*sorted(times), end + length]:
            if start is None or ts >= start + length:
                if start is not None and start + length <= end:
                    out.append((user, scope, start, n))
                start, n = ts, 0
            n += 1
    return sorted(out)


def test_client_windows_start_with_the_first_request(spark):
    rng = random.Random(3)
    rows = [(i, T0 + dt.timedelta(seconds=rng.randrange(4 * 3600)), rng.choice([1, 2, 3, 4, None]), rng.choice(["view", "signup"]), 0.0, "{}") for i in range(400)]
    rows += [(500 + k, T0 + dt.timedelta(minutes=15 * k), 6, "view", 0.0, "{}") for k in range(4)]  # each exactly when the window before ends
    rows.sort(key=lambda r: r[1])
    batches = cut(rng, rows, 5)
    for a, b in zip(batches, batches[1:]):  # rows that come a batch late, but before the watermark
        late = [r for r in a if r[1] > a[-1][1] - dt.timedelta(minutes=9)][:6]
        for r in late:
            a.remove(r)
            b.append(r)
    closing = T0 + dt.timedelta(days=1)
    stream = files(spark, scratch_dir(spark, "events"), [*batches, [(900, closing, -1, "view", 0.0, "{}")]], EVENTS)
    with K.rocksdb(spark):
        got = TS.stream_to_table(spark, K.stream_client_windows(stream, auth_limit=2), "clients").collect()
    want = windows(rows, closing - dt.timedelta(minutes=10))
    assert sorted((r.user_id, r.scope, r.window_start, r.requests) for r in got) == want
    assert all(r.window_end == r.window_start + dt.timedelta(minutes=15) and r.over_limit == (r.requests > (2 if r.scope == "auth" else 5000)) for r in got)
    assert any(r.over_limit for r in got)


def commands(rng, shows=3, n=160):
    rows, at = [], T0
    for i in range(n):
        at += dt.timedelta(minutes=rng.randrange(3))
        show, kind = rng.randrange(shows), rng.choice(["book", "book", "cancel", "payment"])
        booked = [r for r in rows if r[3] == "book" and r[0] == show]
        if kind == "book" or not booked:
            rows.append((show, at, i, "book", 1000 + i, rng.randrange(4), False, [show * 100 + s for s in rng.sample(range(12), 2)], rng.random() < 0.95, rng.random() < 0.95, D("5.00"), None, None))
        else:
            b = rng.choice(booked)
            rows.append((show, at, i, kind, b[4], b[5] if rng.random() < 0.8 else 9, rng.random() < 0.1, None, None, None, None, rng.choice(["SUCCESS", "FAILED", "FAILED", "OTHER"]) if kind == "payment" else None, None))
    return rows


def outcomes(df):
    return sorted((r.show_id, r.cmd_id, r.outcome, r.booking_status, r.unavailable_seats) for r in df.collect())


def test_seat_ledger_equals_the_batch_replay_over_restarts(spark):
    rows = commands(random.Random(5))
    src, root = scratch_dir(spark, "commands"), scratch_dir(spark, "ledger")
    for part in cut(random.Random(6), rows, 3):  # three runs over one checkpoint
        changes = K.seat_changes(spark, files(spark, src, [part], COMMAND_SCHEMA), root)
    log = spark.createDataFrame(rows, COMMAND_SCHEMA)
    assert outcomes(K.seat_outcomes(changes)) == outcomes(replay_booking_log(log))
    taken, held = {}, {}
    for r in sorted(changes.collect(), key=lambda r: (r.at, r.cmd_id)):
        for s in r.seat_ids if r.is_available >= 0 else ():
            taken[(r.show_id, s)] = r.is_available
    assert {(r.show_id, r.seat_id): r.is_available for r in K.seat_availability(changes).collect()} == taken and len(taken) > 20 and held == {}


def test_state_of_finished_shows_goes(spark):
    book = lambda i, show, at, seat: (show, at, i, "book", 1000 + i, 1, False, [seat], True, True, D("5.00"), None, None)
    cancel = (1, T0 + dt.timedelta(hours=1), 2, "cancel", 1001, 1, False, None, None, None, None, None, None)
    after = T0 + dt.timedelta(days=9)
    batches = [[book(1, 1, T0, 11), cancel], [book(3, 1, T0 + dt.timedelta(hours=2), 11)], [book(4, 2, after, 21)], [book(5, 2, after + dt.timedelta(hours=1), 22)],
               [book(6, 2, after + dt.timedelta(hours=2), 21), book(7, 1, after + dt.timedelta(hours=2), 12)]]
    ends = spark.createDataFrame([(1, T0 + dt.timedelta(days=1))], "show_id long, ends_at timestamp_ntz")
    changes = K.seat_changes(spark, files(spark, scratch_dir(spark, "commands"), batches, COMMAND_SCHEMA), scratch_dir(spark, "ledger"), ends)
    got = {r.cmd_id: r.outcome for r in changes.collect()}
    assert got == {1: "ACCEPTED", 2: "CANCELLED", 3: "ACCEPTED", 4: "ACCEPTED", 5: "ACCEPTED", 6: "CONFLICT", 7: "LATE"}


class CountedMap(dict):
    """Map state that counts what goes to and from it."""
    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def iterator(self):
        return iter(list(self.items()))


def test_seat_state_goes_by_chunks():
    state, n, size, seats, booked, rng = CountedMap(), 1, 0, set(), set(), random.Random(8)
    for batch in range(20):
        state.calls, chunks = 0, K._Chunks(state, n, size)
        taken, bookings = K._Taken(chunks), K._Bookings(chunks)
        for _ in range(20 if batch < 10 else 400):
            i = rng.randrange(10**6) * 20000 + 7  # ids of one remainder still spread
            taken.update([i])
            seats.add(i)
            bookings[i] = {"owner": 1, "status": "CONFIRMED", "seats": [i], "paid": True}
            booked.add(i)
            if rng.random() < 0.2:
                gone = rng.choice(sorted(seats))
                taken.difference_update([gone])
                seats.discard(gone)
            assert i in bookings.chunks.of(i)[1] and 5 not in taken and bookings.get(5) is None
        chunks.save()
        n, size = chunks.n, chunks.size
        assert size == len(seats) + len(booked) and size <= K.CHUNK * n and (batch >= 10 or state.calls <= 2)
        assert {s for v in state.values() for s in v[0]} == seats and {b[0] for v in state.values() for b in v[1]} == booked
    assert n == 8 and max(len(v[0]) + len(v[1]) for v in state.values()) < 2 * K.CHUNK


def test_bucket_table(spark):
    root = scratch_dir(spark, "buckets")
    t = BucketTable(spark, root, "k long, v string", ["k"], 8)
    assert t.latest() is None and t.read(t.latest()).collect() == []
    t.write(spark.createDataFrame([(k, "old") for k in range(100)], "k long, v string"), 0)
    new = spark.createDataFrame([(3, "new"), (500, "new")], "k long, v string")
    here = t.touched(new)
    assert len(here) <= 2
    t.write(t.read(0, here).filter("k <> 3").unionByName(new), 1, here, 0)
    assert {r.k: r.v for r in t.read(1).collect()} == {**dict.fromkeys(range(100), "old"), 3: "new", 500: "new"}
    assert {r.k: r.v for r in t.read(0).collect()} == dict.fromkeys(range(100), "old")  # the version before stays whole
    assert sorted(d for d in os.listdir(os.path.join(root.removeprefix("file:"), "data", "v1")) if d.startswith("_bucket")) == [f"_bucket={b}" for b in here]
    t.write(spark.createDataFrame([], "k long, v string"), 2, here, 1)  # buckets that become empty
    assert {r.k for r in t.read(2).collect()} == {k for k in range(100) if k not in {r.k for r in t.read(1, here).collect()}}
    t.forget(2)
    assert t.latest(2) is None and t.read(2).count() + t.read(2, here).count() == t.read(2).count()


def test_rating_upkeep_writes_touched_buckets_only(spark):
    reviews = [(i, i % 50, i % 20, 1 + i % 5, None, T0) for i in range(400)]
    from marquee.sources.schemas import TABLES
    root, src = scratch_dir(spark, "ratings"), scratch_dir(spark, "reviews")
    schema = "review_id long, user_id long, show_id long, rating int, comment string, reviewed_at timestamp_ntz, op string, event_ts timestamp_ntz"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [[(5, 5, 5, 1, None, T0, "upsert", at(1)), (5, 5, 5, 4, None, T0, "upsert", at(2))], [(5, 5, 5, None, None, T0, "delete", at(3)), (900, 1, 77, 3, None, T0, "upsert", at(3))],
               [(6, 6, 8, 2, None, T0, "upsert", at(4)), (1000, 1, 1, None, None, T0, "delete", at(4))]]  # a review that moves; one that never was
    seed = spark.createDataFrame(reviews, TABLES["reviews"])
    for rows in batches:  # a restart before each
        got = TS.stream_rating_upkeep(spark, files(spark, src, [rows], schema), seed, root)
    now = {r[0]: (r[2], r[3]) for r in reviews}
    for rows in batches:
        for i, _, show, rating, _, _, op, _ in rows:
            now.pop(i, None)
            if op == "upsert":
                now[i] = (show, rating)
    want = {}
    for show, rating in now.values():
        want.setdefault(show, []).append(rating)
    assert {r.show_id: (r.avg_rating, r.review_count) for r in got.collect()} == {
        s: ((D(sum(v)) / len(v)).quantize(D("0.01"), rounding="ROUND_HALF_UP"), len(v)) for s, v in want.items()}
    table = TS.rating_tables(spark, root)[0]
    written = [sum(v == e for v in table.pointer(table.latest()).values()) for e in (1, 2, 3)]
    assert max(written) <= 2 and sum(v == 0 for v in table.pointer(table.latest()).values()) >= table.buckets - 6


def test_bulk_mailings_are_told_apart(spark, seed):
    path = scratch_dir(spark, "bulk")
    may, june = ("Spring", "Hello"), ("Summer", "Hello")
    for subject, message in (may, june, may):
        N.outbox_sink(N.outbox_messages(seed["users"], "bulk", subject, message), path)
    sent = spark.read.parquet(path)
    assert {r[0]: r[1] for r in sent.groupBy("subject").count().collect()} == {"Spring": 6, "Summer": 6}
    N.outbox_sink(N.outbox_messages(seed["users"], "bulk", *may, mailing="spring-again"), path)
    assert spark.read.parquet(path).filter("subject = 'Spring'").count() == 12
    with pytest.raises(ValueError):
        N.outbox_messages(seed["users"], "bulk", "", "x")
    assert sent.filter(F.col("message_id").startswith("bulk:")).count() == 12
