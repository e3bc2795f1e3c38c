"""T1's state: a span of shows in one value, large shows in chunks."""

import datetime as dt
import random
from decimal import Decimal as D
from types import SimpleNamespace

import pandas as pd
import pytest

from marquee.operators.replay import COMMAND_SCHEMA, NOBODY, ShowLedger, replay_booking_log
from marquee.session import scratch_dir
from marquee.streaming import keyed as K
from marquee.streaming import streams as TS

T0 = dt.datetime(2024, 1, 1)


class Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None


class Map(dict):
    calls = 0

    def getValue(self, key):
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)


class Handle:
    def __init__(self):
        self.value, self.map, self.timers = Value(), Map(), set()

    def getValueState(self, *_):
        return self.value

    def getMapState(self, *_):
        return self.map

    def registerTimer(self, at):
        self.timers.add(at)


def command(rng, k, shows, seats):
    show, kind = rng.choice(shows), rng.choice(["book", "book", "cancel", "payment", "refund"])
    asked = rng.sample(range(seats), rng.randrange(4)) if kind == "book" else []
    return SimpleNamespace(show_id=show, at=rng.randrange(1000), cmd_id=k, kind=kind, booking_id=k if kind == "book" else rng.randrange(k + 1), actor_id=rng.choice([1, 2, NOBODY]),
                           actor_is_admin=rng.random() < 0.3, seat_ids=[show * 1000 + s for s in asked], seat_ok=rng.random() < 0.9, food_ok=rng.random() < 0.9,
                           payment_status=rng.choice(["SUCCESS", "FAILED", None]), ends=K.UNKNOWN)


def text(c):
    flags = K.ADMIN * c.actor_is_admin | K.SEAT_OK * c.seat_ok | K.FOOD_OK * c.food_ok | {"SUCCESS": K.SUCCESS, "FAILED": K.FAILED, None: 0}[c.payment_status]
    seats = c.seat_ids if c.kind == "book" and c.seat_ok else []
    return ",".join(map(str, [c.show_id, c.at, c.cmd_id, c.booking_id, c.actor_id, c.ends, flags, *seats])) + f"|{c.kind}"


def run(handle, commands):
    ledger = K.SeatLedger()
    ledger.init(handle)
    frames = [pd.DataFrame({"command": [text(c) for c in commands[i::2]]}) for i in range(2)]
    return [r for d in ledger.handleInputRows((0,), iter(frames), None) for r in d.itertuples(index=False)]


@pytest.mark.parametrize("small", [3, 256])
def test_a_span_of_shows_gives_the_outcomes_of_each_show(monkeypatch, small):
    monkeypatch.setattr(K, "SMALL", small)
    monkeypatch.setattr(K, "CHUNK", 5)
    rng, handle, plain, k = random.Random(small), Handle(), {}, 0
    for batch in range(12):
        commands = [command(rng, k + i, [-3, 0, 5, 7, 2**40], 40) for i in range(60)]
        k += 60
        for c in commands:
            c.at += batch * 700  # some come late
        want = {}
        for c in sorted(commands, key=lambda c: (c.show_id, c.at, c.cmd_id)):
            ledger = plain.setdefault(c.show_id, ShowLedger())
            if ledger.last is not None and (c.at, c.cmd_id) < ledger.last:
                want[c.cmd_id] = ("LATE", None, None)
                continue
            ledger.last = (c.at, c.cmd_id)
            want[c.cmd_id] = ledger.apply(c)
        got = {r.cmd_id: (r.outcome, r.booking_status, r.unavailable_seats) for r in run(handle, commands)}
        assert got == want
    assert len({o for o, _, _ in got.values()}) > 3 and (len(handle.map) > 8) == (small == 3)


def test_the_shows_of_a_span_cost_a_few_calls_of_the_state():
    rng, handle = random.Random(1), Handle()
    for batch in range(3):
        run(handle, [command(rng, batch * 500 + i, range(64), 300) for i in range(500)])
    assert handle.value.calls == 6 and handle.map.calls == 0 and not handle.map


def test_shows_that_are_over_leave_their_span(monkeypatch):
    monkeypatch.setattr(K, "SMALL", 3)
    rng, handle = random.Random(2), Handle()
    commands = [command(rng, i, [1, 2, 3], 60) for i in range(90)]
    for c in commands:
        c.ends = {1: 5_000_000, 2: 9_000_000, 3: K.UNKNOWN}[c.show_id]
    run(handle, commands)
    assert handle.timers == {5001, 9001} and {show for show, _ in handle.map} == {1, 2, 3}
    for due, left in ((5000, {1, 2, 3}), (5001, {2, 3}), (9001, {3})):
        ledger = K.SeatLedger()
        ledger.init(handle)
        assert list(ledger.handleExpiredTimer((0,), None, SimpleNamespace(getExpiryTimeInMs=lambda due=due: due))) == []
        assert set(ledger._read()) == left == {show for show, _ in handle.map}


def test_unknown_times_and_kinds_pass_through_the_stream(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(70, None, 1, "book", 11, 1, False, [5, 6], True, True, D("5.00"), None, None), (70, at(1), 2, "book", 12, 2, None, [6], True, None, None, None, None),
            (70, at(2), 3, None, 11, 2, True, None, None, None, None, "FAILED", None), (70, at(3), 4, "book", 13, 2, False, [None, 6], False, True, None, None, None),
            (70, at(4), 5, "a|b,c", 11, 1, None, None, None, None, None, "LOST", None), (-1, at(1), 6, "book", 14, 1, False, [], True, True, None, None, None),
            (None, at(1), 7, "cancel", 14, 1, False, None, None, None, None, None, None)]
    path = scratch_dir(spark, "commands")
    spark.createDataFrame(rows, COMMAND_SCHEMA).write.parquet(path)
    changes = K.seat_changes(spark, TS.file_stream(spark, path, COMMAND_SCHEMA, 9), scratch_dir(spark, "ledger"))
    got = {r.cmd_id: (r.at is None, r.kind, r.outcome, r.booking_status, r.unavailable_seats, r.seat_ids, r.is_available) for r in changes.collect()}
    assert got == {1: (True, "book", "ACCEPTED", "CONFIRMED", None, [5, 6], 0), 2: (False, "book", "CONFLICT", None, "6", [], -1),
                   3: (False, None, "APPLIED", "CANCELLED", None, [5, 6], 1), 4: (False, "book", "INVALID_SEAT", None, None, [], -1),
                   5: (False, "a|b,c", "INVALID_STATUS", "CANCELLED", None, [], -1), 6: (False, "book", "ACCEPTED", "CONFIRMED", None, [], 0)}
    log = spark.createDataFrame([r for r in rows if r[0] is not None], COMMAND_SCHEMA)
    assert {(r.cmd_id, r.outcome) for r in K.seat_outcomes(changes).collect()} == {(r.cmd_id, r.outcome) for r in replay_booking_log(log.filter("cmd_id <> 4")).collect()} | {(4, "INVALID_SEAT")}
