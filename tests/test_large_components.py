"""Large conflict components: seat timelines (M16) and slices of the arrival order (M1) against the answer in order."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from marquee.operators import allocate as AL
from marquee.operators import replay as RP
from marquee.operators import timelines as TL
from tests.test_keyed_streams import T0, commands, outcomes


@pytest.mark.parametrize("seed,large,rounds", [(1, 5, 40), (2, 5, 40), (3, 30, 40), (4, 5, 2), (5, 5, 40)])
def test_timelines_equal_the_replay_in_order(spark, seed, large, rounds):
    rng = random.Random(seed)
    rows = commands(rng, shows=4, n=150)
    rows += [(None, T0, 9000, "cancel", 5, 1, False, None, None, None, None, None, None)]
    # a booking whose cancel comes before it, and one that fails twice after another has its seats
    early, late = T0 - dt.timedelta(hours=1), T0 + dt.timedelta(days=9)
    rows += [(9, early, 9001, "cancel", 9002, 1, False, None, None, None, None, None, None), (9, T0, 9002, "book", 9002, 1, False, [900, 901], True, True, D("1.00"), None, None)]
    for k, (kind, status) in enumerate([("payment", "FAILED"), ("book", None), ("payment", "FAILED"), ("book", None), ("payment", "SUCCESS"), ("cancel", None), ("payment", "SUCCESS"), ("book", None), ("cancel", None)]):
        cid = 9010 + k
        rows.append((9, late + dt.timedelta(minutes=k), cid, kind, cid if kind == "book" else 9002, 1, False, [900, 902 + k] if kind == "book" else None,
                     True if kind == "book" else None, True if kind == "book" else None, None, status, None))
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, RP.COMMAND_SCHEMA)
    want = [r for r in outcomes(RP.replay_booking_log(log.filter("show_id is not null"), large=10**9))]
    got = RP.replay_booking_log(log, large=large, rounds=rounds)
    assert sorted(r for r in outcomes(got.filter("show_id is not null"))) == want
    assert [r.outcome for r in got.filter("show_id is null").collect()] == ["NOT_FOUND"]


def test_one_busy_show_settles_in_few_rounds(spark):
    """One show with all commands: the fixpoint spreads over tasks and needs far fewer rounds than commands."""
    log = spark.createDataFrame(commands(random.Random(8), shows=1, n=3000), RP.COMMAND_SCHEMA).withColumn("part", F.lit(1).cast("long"))
    done, left, rounds = TL.replay_large(log, 40)
    assert left.isEmpty() and rounds < 40
    assert outcomes(done) == outcomes(RP.replay_booking_log(log.drop("part"), large=10**9))


def test_repeated_bookings_are_replayed_in_order(spark):
    rows = commands(random.Random(2), shows=1, n=60)
    again = [(*r[:2], r[2] + 5000, *r[3:]) for r in rows if r[3] == "book"][:2]
    log = spark.createDataFrame(rows + again, RP.COMMAND_SCHEMA)
    assert outcomes(RP.replay_booking_log(log, large=5)) == outcomes(RP.replay_booking_log(log, large=10**9))


def in_order(pairs):
    reqs = {}
    for r, t, s, held in pairs:
        reqs.setdefault((t, r), []).append((s, held))
    taken, won = set(), set()
    for key in sorted(reqs):
        if not any(h or s in taken for s, h in reqs[key]):
            taken |= {s for s, _ in reqs[key]}
            won.add(key[1])
    return won


def run_fixpoint(spark, pairs, task_pairs):
    df = spark.createDataFrame(pairs, "request_id long, requested_at timestamp_ntz, seat_id long, held boolean")
    accepted, rounds = AL.fixpoint(df, task_pairs)
    return {r.request_id for r in accepted.collect()}, rounds


@pytest.mark.parametrize("seed", [1, 2])
def test_slices_equal_the_order(spark, seed):
    rng = random.Random(seed)
    pairs = [(r, T0 + dt.timedelta(seconds=rng.randrange(200)), s, s % 17 == 0) for r in range(300) for s in rng.sample(range(400), rng.randrange(1, 4))]
    times = {}
    pairs = [(r, times.setdefault(r, t), s, h) for r, t, s, h in pairs]
    assert run_fixpoint(spark, pairs, 20)[0] == in_order(pairs)


def test_a_long_chain_follows_the_slices(spark):
    n, size = 20_000, 8_000  # request r wants seats r and r + 1
    pairs = [(r, T0, s, False) for r in range(n) for s in (r, r + 1)]
    won, rounds = run_fixpoint(spark, pairs, size)
    assert won == set(range(0, n, 2))
    assert rounds <= AL.SET_ROUNDS + 2 * n // size + 1
