"""Streams with state per key and timers (``transformWithState``, RocksDB).

- T6 ``stream_revenue_changes``: each booking's last status is kept, in one value for a span of booking ids; a
  change emits minus the old and plus the new state, and the shows' totals follow
  by signed sums, so cancelled revenue is taken back.
- T3 ``stream_client_windows``: a limit window starts with a client's first request and
  closes its length later, by a timer.
- T1 ``stream_seat_ledger``: the taken seats and bookings of a span of shows lie in one value; a show that
  is too large for it lies in chunks of map state, and a batch touches only the chunks that its commands name.

State is read and written key by key in the state store (a key of T1 and T6 is a span of ids, of bounded size), so a batch costs what it
brings and not what came before.  Results do not hang on how the stream is cut
into batches, but for rows behind the watermark (T3) or behind their show's last command (T1).
"""

from __future__ import annotations

import os
import sys
from array import array
from collections import namedtuple
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import groupby
from operator import itemgetter

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from marquee.operators.replay import COMMAND_SCHEMA, OUTCOME_SCHEMA, ShowLedger
from marquee.plans.buckets import BucketTable
from marquee.plans.lineage import materialize
from marquee.session import scratch_dir
from marquee.streaming.streams import API_LIMIT, AUTH_LIMIT, run_available_now

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


@contextmanager
def rocksdb(spark: SparkSession):
    """State with timers and maps needs the RocksDB store, whatever the session's default is."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def micros(col: str) -> F.Column:
    """Microseconds of a TIMESTAMP_NTZ column, in no time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {col})")


def moment(col: str) -> F.Column:
    return F.expr(f"timestampadd(MICROSECOND, {col}, {EPOCH})")


# --------------------------------------------------------------------------
# Revenue that follows every status change
# --------------------------------------------------------------------------
SIGNED = "show_id long, booking_id long, cents long, bookings long"
TOTALS = "show_id long, cents long, bookings long"
SPAN_BITS = 10  # 1,024 neighbouring booking ids share one state value
UNKNOWN = -(1 << 63)  # an unknown time or id is before all others


class StatusChanges(StatefulProcessor):
    """The changes of a span of neighbouring booking ids -> minus the old and plus the new share of a show's revenue.

    The state is each booking's last change by (time, id), so older and repeated changes do nothing, whenever they come.
    The bookings of a span lie in one value, rows of six longs, which is read and written as a whole: a few calls to the
    state store per span and batch, not per booking, and a span never holds more bookings than it has ids."""

    COLUMNS = ("booking_id", "show_id", "cents", "confirmed", "at", "change_id")

    def init(self, handle) -> None:
        self.now = handle.getValueState("now", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        known = self.now.get()
        old = np.frombuffer(known[0] if known is not None else b"", dtype="<i8").reshape(-1, 6)
        every = old
        for pdf in rows:  # one change per booking is kept, however many come
            every = self._last(np.concatenate([every, pdf[list(self.COLUMNS)].to_numpy(dtype="<i8")]))
        if np.array_equal(every, old):
            return
        self.now.update((every.tobytes(),))
        here = np.searchsorted(every[:, 0], old[:, 0])  # a booking never leaves
        moved = (every[here] != old).any(axis=1)
        fresh = np.ones(len(every), dtype=bool)
        fresh[here[~moved]] = False
        gone, came = old[moved], every[fresh]
        out = np.concatenate([r[r[:, 3] == 1][:, :4] * np.array([1, 1, sign, sign]) for r, sign in ((gone, -1), (came, 1))])
        if len(out):
            yield pd.DataFrame({"show_id": out[:, 1], "booking_id": out[:, 0], "cents": out[:, 2], "bookings": out[:, 3]})

    @staticmethod
    def _last(rows):
        """The last change of each booking; of equal ones the one that came first."""
        import numpy as np

        rows = rows[np.lexsort((-np.arange(len(rows)), rows[:, 5], rows[:, 4], rows[:, 0]))]
        return rows[np.append(rows[1:, 0] != rows[:-1, 0], True)] if len(rows) else rows


def signed_revenue(changes: DataFrame) -> DataFrame:
    """(booking_id, show_id, total_amount, booking_status, changed_at, change_id) -> signed shares of CONFIRMED revenue."""
    unknown = F.lit(UNKNOWN).cast("long")
    told = changes.filter("booking_id is not null and show_id is not null").select(
        F.shiftright(F.col("booking_id").cast("long"), SPAN_BITS).alias("span"), F.col("booking_id").cast("long").alias("booking_id"), F.col("show_id").cast("long").alias("show_id"),
        F.coalesce((F.col("total_amount") * 100).cast("long"), F.lit(0).cast("long")).alias("cents"),
        F.coalesce(F.col("booking_status") == "CONFIRMED", F.lit(False)).cast("long").alias("confirmed"),
        F.coalesce(micros("changed_at").cast("long"), unknown).alias("at"), F.coalesce(F.col("change_id").cast("long"), unknown).alias("change_id"))
    return told.groupBy("span").transformWithStateInPandas(StatusChanges(), SIGNED, "append", "none")


def revenue_table(spark: SparkSession, root: str, buckets: int = 32) -> BucketTable:
    return BucketTable(spark, os.path.join(root, "revenue"), TOTALS, ["show_id"], buckets)


def add_signed(table: BucketTable, signed: DataFrame, epoch: int) -> None:
    """foreachBatch body: version epoch + 1 is the version before plus this batch's signed shares, in the touched buckets only."""
    sums = materialize(signed.groupBy("show_id").agg(F.sum("cents").alias("cents"), F.sum("bookings").alias("bookings")), "t6-signed")
    base = table.latest(epoch + 1)
    here = table.touched(sums)
    new = table.read(base, here).unionByName(sums).groupBy("show_id").agg(F.sum("cents").alias("cents"), F.sum("bookings").alias("bookings"))
    table.write(new.filter("bookings <> 0 or cents <> 0"), epoch + 1, here, base)


def revenue_now(table: BucketTable) -> DataFrame:
    return table.read(table.latest()).filter("bookings > 0").select("show_id", (F.col("cents") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)").alias("revenue"), "bookings")


def stream_revenue_changes(spark: SparkSession, changes: DataFrame, root: str) -> DataFrame:
    """(show_id, revenue, bookings) of the CONFIRMED bookings after all status changes of the stream."""
    table = revenue_table(spark, root)
    with rocksdb(spark):
        run_available_now(signed_revenue(changes).writeStream.foreachBatch(lambda df, epoch: add_signed(table, df, epoch)), os.path.join(root, "_checkpoint"))
    return revenue_now(table)


# --------------------------------------------------------------------------
# Limit windows that start with a client's first request
# --------------------------------------------------------------------------
class ClientWindows(StatefulProcessor):
    """A client's requests -> its windows, each ``length`` microseconds from its first request.

    Requests wait (as counts by time) until the watermark has passed them, then they are taken in order of time, so
    requests that come late but before the watermark fall into the right window.  A timer wakes the client
    when its earliest waiting request or its open window's end is due.  What waits is one list, read and written
    as a whole: a call to the state store per batch and client, not several per request."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, requests long")
        self.open = handle.getValueState("open", "start long, requests long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        counts: dict[int, int] = {}
        for r in rows:
            counts[r.at] = counts.get(r.at, 0) + 1
        yield from self._advance(key, timerValues, counts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, timerValues, {})

    def _advance(self, key, timerValues, counts) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # nothing before it comes any more
        before = [(w[0], w[1]) for w in self.waiting.get()]
        for at, n in before:
            counts[at] = counts.get(at, 0) + n
        waiting = sorted(counts.items())
        known = now = self.open.get()
        for at, n in waiting:
            if at >= passed:
                break
            if now is not None and at < now[0] + self.length:
                now = (now[0], now[1] + n)
                continue
            if now is not None:
                yield self._row(key, now)
            now = (at, n)
        if now is not None and now[0] + self.length <= passed:
            yield self._row(key, now)
            now = None
        if now is not known:
            if now is None:
                self.open.clear()
            else:
                self.open.update(tuple(now))
        waiting = [w for w in waiting if w[0] >= passed]
        if waiting != before:
            if waiting:
                self.waiting.put(waiting)
            else:
                self.waiting.clear()
        due = [at for at, _ in waiting[:1]] + ([now[0] + self.length] if now else [])
        if due:
            self.handle.registerTimer(min(due) // 1000 + 1)

    def _row(self, key, window) -> Row:
        return Row(user_id=key[0], scope=key[1], start=window[0], requests=window[1])


def _scoped(events: DataFrame) -> DataFrame:
    """A row per request and limit that it counts against: every request is an api request, sign-ups are auth requests too."""
    kinds = F.when(F.col("event_type") == "signup", F.array(F.lit("api"), F.lit("auth"))).otherwise(F.array(F.lit("api")))
    return events.filter("user_id is not null and ts is not null").select("user_id", F.explode(kinds).alias("scope"), micros("ts").alias("at"), F.col("ts").cast("timestamp").alias("_et"))


def stream_client_windows(events: DataFrame, minutes: int = 15, watermark: str = "10 minutes", api_limit: int = API_LIMIT, auth_limit: int = AUTH_LIMIT) -> DataFrame:
    """(user_id, scope, window_start, window_end, requests, request_limit, over_limit) of every closed window."""
    length = minutes * 60_000_000
    rows = _scoped(events).withWatermark("_et", watermark)
    out = rows.groupBy("user_id", "scope").transformWithState(ClientWindows(length), "user_id long, scope string, start long, requests long", "append", "eventTime")
    limit = F.when(F.col("scope") == "auth", F.lit(auth_limit)).otherwise(F.lit(api_limit))
    return out.select("user_id", "scope", moment("start").alias("window_start"), moment(f"start + {length}").alias("window_end"), "requests",
                      limit.alias("request_limit"), (F.col("requests") > limit).alias("over_limit"))


# --------------------------------------------------------------------------
# Seats and bookings of a span of shows in one value, those of a large show as chunks of map state
# --------------------------------------------------------------------------
CHANGES = "show_id long, at long, cmd_id long, kind string, booking_id long, outcome string, booking_status string, unavailable_seats string, seat_ids array<long>, is_available int"


SHOW_BITS = 6  # 64 neighbouring show ids share one state value
SMALL = 256  # taken seats and bookings of a show up to which it lies there
CHUNK = 1000  # ids that a chunk of a larger show's state holds on average, at most
BOOKINGS = "array<struct<id: long, owner: long, status: string, seats: array<long>, paid: boolean>>"


class _Chunks:
    """A show's taken seats and bookings over map state, dealt by a hash of their ids into chunks, each read and written as a
    whole once a batch.  They begin as one chunk; when the chunks hold more than ``CHUNK`` ids on average their number
    doubles, so a batch on a large show still moves only the chunks that its commands name."""

    def __init__(self, state, n: int, size: int):
        self.state, self.n, self.size, self.known, self.changed = state, n, size, {}, set()

    def number(self, i: int) -> int:
        return (i * 0x9E3779B97F4A7C15 % 2**64 >> 32) % self.n

    def of(self, i: int, change: bool = False) -> tuple[set, dict]:
        k = self.number(i)
        if k not in self.known:
            v = self.state.getValue((k,)) if self.size else None
            self.known[k] = self._read(v) if v is not None else (set(), {})
            self.size -= self._ids(k)  # counted again when it is saved
        if change:
            self.changed.add(k)
        return self.known[k]

    @staticmethod
    def _read(v) -> tuple[set, dict]:
        return set(v[0]), {b[0]: {"owner": b[1], "status": b[2], "seats": list(b[3]), "paid": b[4]} for b in v[1]}

    def _ids(self, k: int) -> int:
        return sum(map(len, self.known[k]))

    def save(self) -> None:
        self.size += sum(map(self._ids, self.known))
        if self.size > CHUNK * self.n:
            if self.n > 1:
                for k, v in self.state.iterator():
                    if k[0] not in self.known:
                        self.known[k[0]] = self._read(v)
            old, self.known = list(self.known.values()), {}
            while self.size > CHUNK * self.n:
                self.n *= 2
            for seats, bookings in old:
                for s in seats:
                    self.known.setdefault(self.number(s), (set(), {}))[0].add(s)
                for i, b in bookings.items():
                    self.known.setdefault(self.number(i), (set(), {}))[1][i] = b
            self.changed = set(self.known)
            self.state.clear()
        for k in self.changed:
            seats, bookings = self.known[k]
            self.state.updateValue((k,), (list(seats), [(i, b["owner"], b["status"], b["seats"], b["paid"]) for i, b in bookings.items()]))


class _Taken:
    """The set of a show's taken seats."""

    def __init__(self, chunks: _Chunks):
        self.chunks = chunks

    def __contains__(self, seat: int) -> bool:
        return seat in self.chunks.of(seat)[0]

    def update(self, seats) -> None:
        for s in seats:
            self.chunks.of(s, True)[0].add(s)

    def difference_update(self, seats) -> None:
        for s in seats:
            self.chunks.of(s, True)[0].discard(s)


class _Bookings:
    """A show's bookings by id; who changes one marks it."""

    def __init__(self, chunks: _Chunks):
        self.chunks = chunks

    def get(self, booking: int) -> dict | None:
        return self.chunks.of(booking)[1].get(booking)

    def __setitem__(self, booking: int, value: dict) -> None:
        self.chunks.of(booking, True)[1][booking] = value

    def mark(self, booking: int) -> None:
        self.chunks.of(booking, True)


class _OfShow:
    """The chunks of one show in the map state of its span; ``n`` is their number before this batch."""

    def __init__(self, state, show: int, n: int):
        self.state, self.show, self.n = state, show, n

    def getValue(self, key):
        return self.state.getValue((self.show, *key))

    def updateValue(self, key, value) -> None:
        self.state.updateValue((self.show, *key), value)

    def iterator(self) -> Iterator:
        for k in range(self.n):
            v = self.getValue((k,))
            if v is not None:
                yield (k,), v

    def clear(self) -> None:
        for k in range(self.n):
            self.state.removeKey((self.show, k))


Command = namedtuple("Command", "show_id at cmd_id booking_id actor_id ends kind seat_ids actor_is_admin seat_ok food_ok payment_status")
ADMIN, SEAT_OK, FOOD_OK, SUCCESS, FAILED = (1 << k for k in range(5))


def _command(text: str) -> Command:
    """A command from the text that ``stream_seat_ledger`` makes of it."""
    numbers, known, kind = text.partition("|")
    show, at, cmd, booking, actor, ends, flags, *seats = map(int, numbers.split(","))
    status = "SUCCESS" if flags & SUCCESS else "FAILED" if flags & FAILED else None
    return Command(show, at, cmd, booking, actor, ends, kind if known else None, seats, flags & ADMIN, flags & SEAT_OK, flags & FOOD_OK, status)


def _pack(seats: set, bookings: dict) -> list[int]:
    """A show's taken seats and bookings as longs."""
    out = [len(seats), *seats]
    for i, b in bookings.items():
        out += (i, b["owner"], (b["status"] == "CONFIRMED") + 2 * bool(b["paid"]), len(b["seats"]))
        out += b["seats"]
    return out


def _unpack(v: list[int]) -> tuple[set, dict]:
    k = v[0] + 1
    seats, bookings = set(v[1:k]), {}
    while k < len(v):
        i, owner, flags, n = v[k:k + 4]
        bookings[i] = {"owner": owner, "status": "CONFIRMED" if flags & 1 else "CANCELLED", "seats": v[k + 4:k + 4 + n], "paid": flags > 1}
        k += 4 + n
    return seats, bookings


class SeatLedger(StatefulProcessor):
    """The commands of a span of neighbouring shows, each show's in order -> their outcomes and the seats that each took
    (is_available 0) or freed (1).

    The shows of a span lie in one value of longs, read and written once a batch: a few calls to the state store per span, not
    per show.  Only shows that the batch names are taken apart.  A show with more than ``SMALL`` taken seats and bookings
    lies in chunks of map state instead, of which a batch touches those that its commands name; the value has its head alone."""

    HEAD = 5  # of a show in the value: time and id of its last command, its end, its number of chunks and their ids

    def init(self, handle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "show_id long, chunk int", f"seats array<long>, bookings {BOOKINGS}")
        self.shows = handle.getValueState("shows", "rows binary")

    def _read(self) -> dict[int, list[int]]:
        known, rows, shows, k = self.shows.get(), array("q"), {}, 0
        if known is not None:
            rows.frombytes(bytes(known[0]))
        rows = rows.tolist()
        while k < len(rows):
            shows[rows[k]] = rows[k + 2:k + 2 + rows[k + 1]]
            k += 2 + rows[k + 1]
        return shows

    def _write(self, shows: dict[int, list[int]]) -> None:
        rows = array("q")
        for show, v in shows.items():
            rows.extend((show, len(v)))
            rows.extend(v)
        self.shows.update((rows.tobytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        shows, out, ends = self._read(), [], set()
        told = sorted((_command(text) for pdf in rows for text in pdf["command"]), key=itemgetter(0, 1, 2))
        served = [self._serve(show, commands, shows, out, ends) for show, commands in groupby(told, itemgetter(0))]
        for end in ends:
            self.handle.registerTimer(end // 1000 + 1)
        if any(served):
            self._write(shows)
        columns = [f.strip().split(" ")[0] for f in CHANGES.split(",")]
        # as objects: a column with an unknown value would else become one of doubles
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(columns, zip(*out))})

    def _serve(self, show: int, commands, shows: dict, out: list, ends: set) -> bool:
        """One show's commands in order; whether any of them was in time."""
        v = shows.get(show)
        at, cmd, end, n, size = v[:self.HEAD] if v else (None, None, UNKNOWN, 0, 0)
        last, served, ledger, chunks = (at, cmd) if v else None, False, ShowLedger(), None
        if n:
            chunks = _Chunks(_OfShow(self.chunks, show, n), n, size)
            ledger.unavailable, ledger.bookings = _Taken(chunks), _Bookings(chunks)
        elif v:
            ledger.unavailable, ledger.bookings = _unpack(v[self.HEAD:])
        for c in commands:
            told = (show, c.at if c.at != UNKNOWN else None, c.cmd_id if c.cmd_id != UNKNOWN else None, c.kind, c.booking_id)
            if last is not None and (c.at, c.cmd_id) < last or c.ends != UNKNOWN and c.at > c.ends:
                out.append((*told, "LATE", None, None, [], -1))
                continue
            last, served = (c.at, c.cmd_id), True
            booked = ledger.bookings.get(c.booking_id)
            held = list(booked["seats"]) if booked else []
            outcome, status, unavailable = ledger.apply(c)
            free = outcome == "CANCELLED" or outcome == "APPLIED" and status == "CANCELLED"
            if n and outcome in ("ACCEPTED", "CANCELLED", "APPLIED"):
                ledger.bookings.mark(c.booking_id)
            seats, available = (c.seat_ids, 0) if outcome == "ACCEPTED" else (held, 1) if free else ([], -1)
            out.append((*told, outcome, status, unavailable, seats, available))
            if c.ends != UNKNOWN:
                end = c.ends
                ends.add(end)
        if not served:
            return False
        if not n and len(ledger.unavailable) + len(ledger.bookings) > SMALL:
            chunks = _Chunks(_OfShow(self.chunks, show, 0), 1, 0)
            _Taken(chunks).update(ledger.unavailable)
            for i, b in ledger.bookings.items():
                chunks.of(i, True)[1][i] = b
        if chunks is not None:
            chunks.save()
            shows[show] = [*last, end, chunks.n, chunks.size]
        else:
            shows[show] = [*last, end, 0, 0, *_pack(ledger.unavailable, ledger.bookings)]
        return True

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        """Shows of the span that are over: their state goes."""
        shows, now = self._read(), expiredTimerInfo.getExpiryTimeInMs()
        over = [show for show, v in shows.items() if v[2] != UNKNOWN and v[2] // 1000 + 1 <= now]
        for show in over:
            _OfShow(self.chunks, show, shows.pop(show)[3]).clear()
        if over and shows:
            self._write(shows)
        elif over:
            self.shows.clear()
        return iter([])


def stream_seat_ledger(commands: DataFrame, ends: DataFrame | None = None, watermark: str = "1 day") -> DataFrame:
    """CHANGES rows of every command of a known show.

    ends (show_id, ends_at; one row a show): a show's state is dropped when the watermark passes ends_at, and commands
    later than that are LATE.  Without it state stays for good."""
    rows = commands.filter("show_id is not null").withColumns({"at": micros("ts"), "_et": F.col("ts").cast("timestamp")})
    if ends is None:
        rows, mode, also = rows.withColumn("ends", F.lit(None).cast("long")), "none", []
    else:
        rows = rows.withWatermark("_et", watermark).join(ends.select("show_id", micros("ends_at").alias("ends")), "show_id", "left")
        mode, also = "eventTime", ["_et"]
    # rows reach Python column by column, so a command goes in as one text: numbers (an unknown one is the least), the
    # flags, the seats that it asks for if they are valid, and its kind
    flags = [("actor_is_admin", ADMIN), ("seat_ok", SEAT_OK), ("food_ok", FOOD_OK), ("payment_status = 'SUCCESS'", SUCCESS), ("payment_status = 'FAILED'", FAILED)]
    numbers = [F.coalesce(F.col(c).cast("long"), F.lit(UNKNOWN).cast("long")) for c in ("show_id", "at", "cmd_id", "booking_id", "actor_id", "ends")]
    numbers.append(reduce(Column.__add__, [F.when(F.expr(test), flag).otherwise(0) for test, flag in flags]))
    seats = F.when(F.expr("kind = 'book' and seat_ok and size(seat_ids) > 0"), F.array_join("seat_ids", ",", "null"))
    text = F.concat_ws("|", F.concat_ws(",", *[c.cast("string") for c in numbers], seats), "kind")
    told = rows.select(F.shiftright(F.col("show_id").cast("long"), SHOW_BITS).alias("span"), text.alias("command"), *also)
    return told.groupBy("span").transformWithStateInPandas(SeatLedger(), CHANGES, "append", mode)


def seat_changes(spark: SparkSession, commands: DataFrame, root: str, ends: DataFrame | None = None) -> DataFrame:
    """Run T1 over what the stream has, into an append-only log of changes under ``root``; the log so far."""
    out = os.path.join(root, "changes")
    with rocksdb(spark):
        writer = stream_seat_ledger(commands, ends).writeStream.outputMode("append").format("parquet").option("path", out)
        run_available_now(writer, os.path.join(root, "_checkpoint"))
    return spark.read.schema(CHANGES).parquet(out)


def seat_outcomes(changes: DataFrame) -> DataFrame:
    return changes.withColumn("ts", moment("at")).select(*[f.name for f in OUTCOME_SCHEMA.fields])


def seat_availability(changes: DataFrame) -> DataFrame:
    """(show_id, seat_id, is_available) of every seat that a booking took or freed, as its last event left it."""
    events = changes.filter("is_available >= 0").select("show_id", F.explode("seat_ids").alias("seat_id"), "is_available", "at", "cmd_id")
    return events.groupBy("show_id", "seat_id").agg(F.max_by("is_available", F.struct("at", "cmd_id")).alias("is_available"))
