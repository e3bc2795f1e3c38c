"""Structured Streaming upkeep of the reference's derived state.

The reference keeps seat availability and ratings with row triggers, limits
request rates per 15-minute window, and sends mail after commits.  Here each is
a streaming query over a file source, writing to a sink under the session's
shared checkpoint directory.  Late-data policy (ours): event-time watermarks
as parameters; rows behind the watermark are dropped where state is bounded,
and the keyed ledger of T1 marks commands older than its last one LATE.

``run_available_now`` drives a query to completion (``trigger(availableNow)``),
which is how batch callers and tests read a stream's final answer.
"""

from __future__ import annotations

import json
import sys
import os
from copy import copy

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from marquee.functions.numeric import rating_round
from marquee.operators.notices import outbox_messages, outbox_sink, reminders_due
from marquee.operators.replay import BOOKING, COMMAND_SCHEMA, OUTCOME_SCHEMA, ShowLedger, replay_from_state
from marquee.plans.buckets import BucketTable
from marquee.plans.lineage import materialize
from marquee.plans.paths import exists, latest_version
from marquee.session import scratch_dir

# Python workers receive this module's functions by value (cloudpickle), so executors
# need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the reference's limiter and documented hold.
API_LIMIT, AUTH_LIMIT = 5000, 100
LIMIT_WINDOW = "15 minutes"
HOLD_LENGTH = "5 minutes"


# --------------------------------------------------------------------------
# sources and driving
# --------------------------------------------------------------------------
def stage_stream_source(df: DataFrame, ts_col: str, path: str, slices: int = 4,
                        files_per_slice: int | None = None) -> tuple[str, int]:
    """Write ``df`` as ``slices`` time-ordered slices, one write after the other, each of
    exactly ``f`` files written by ``f`` parallel tasks (round-robin).  A file stream
    reading ``f`` files per trigger then gets one slice per micro-batch, in event-time
    order.  Slice bounds are approximate quantiles of the timestamp; the driver only
    sees ``slices - 1`` bounds and ``slices`` counts.  Returns (path, f)."""
    spark = df.sparkSession
    ts_long = F.unix_micros(F.col(ts_col).cast("timestamp"))
    qs = df.select(ts_long.alias("_t")).approxQuantile("_t", [i / slices for i in range(1, slices)], 0.001) if slices > 1 else []
    bounds = sorted(set(int(q) for q in qs))
    slice_no = F.lit(0)
    for b in bounds:
        slice_no = slice_no + F.when(ts_long >= b, 1).otherwise(0)
    tagged = df.withColumn("_slice", slice_no)
    counts = {r["_slice"]: r["n"] for r in tagged.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    f = min(files_per_slice or int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, sum(counts.values())))
    groups, group, rows = [], [], 0  # neighbouring thin slices are one, so that each fills its f files
    for i in sorted(counts):
        group, rows = [*group, i], rows + counts[i]
        if rows >= f:
            groups, group, rows = [*groups, group], [], 0
    if group:
        groups = [*groups[:-1], [*(groups[-1] if groups else []), *group]]
    for group in groups:
        tagged.filter(F.col("_slice").isin(group)).drop("_slice").repartition(f).write.mode("append").parquet(path)
    return path, f


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available_now(writer, checkpoint: str):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _event_time(df: DataFrame, col: str, delay: str) -> DataFrame:
    """Watermarks need TIMESTAMP; the tables carry TIMESTAMP_NTZ (read under a UTC session)."""
    return df.withColumn("_et", F.col(col).cast("timestamp")).withWatermark("_et", delay)


# --------------------------------------------------------------------------
# Seat state from the command log (keyed ledger per show)
# --------------------------------------------------------------------------
_LEDGER_STATE = T.StructType([T.StructField("ledger", T.StringType())])


def _ledger_step(key, pdfs, state):
    ledger = ShowLedger(json.loads(state.get[0])) if state.exists else ShowLedger()
    batch = pd.concat(list(pdfs), ignore_index=True).sort_values(["ts", "cmd_id"], kind="stable")
    out = []
    for c in batch.itertuples(index=False):
        k = (int(pd.Timestamp(c.ts).value // 1000), int(c.cmd_id))
        if ledger.last is not None and k < tuple(ledger.last):
            out.append((c.show_id, c.ts, c.cmd_id, c.kind, c.booking_id, "LATE", None, None))
            continue
        outcome, status, unavail = ledger.apply(c)
        ledger.last = k
        out.append((c.show_id, c.ts, c.cmd_id, c.kind, c.booking_id, outcome, status, unavail))
    state.update((ledger.to_json(),))
    yield pd.DataFrame(out, columns=[f.name for f in OUTCOME_SCHEMA.fields])


def stream_seat_state(commands: DataFrame) -> DataFrame:
    """The per-row seat triggers as keyed state: each show's ledger (unavailable
    seats, bookings) lives in the state store; a micro-batch only brings that show's
    new commands.  Output: the outcome of every command (append)."""
    return (commands.filter(F.col("show_id").isNotNull()).groupBy("show_id")
            .applyInPandasWithState(_ledger_step, OUTCOME_SCHEMA, _LEDGER_STATE, "append", GroupStateTimeout.NoTimeout))


_SEAT_TABLES = {
    "bookings": "show_id long, booking_id long, owner long, booking_status string, seat_ids array<long>, paid boolean",
    "seats": "show_id long, seat_id long, is_available int, ts timestamp_ntz, cmd_id long",
    "clock": "show_id long, ts timestamp_ntz, cmd_id long",
}


def seat_upkeep_batch(spark: SparkSession, commands: DataFrame, epoch: int, root: str) -> None:
    """foreachBatch body.  State is three versioned Parquet tables under ``root``: bookings, seats (the last event of
    each seat that was ever taken) and each show's last command.  Batch ``e`` reads version e-1 and writes version e
    and its outcomes (idempotent).  The commands are dealt out by seat-conflict component, so a show with most of
    them spreads over tasks; only bookings that the batch names and seats that those ask for or hold enter it."""
    old = {t: spark.createDataFrame([], ddl) if epoch == 0 else spark.read.schema(ddl).parquet(_version(root, t, epoch - 1))
           for t, ddl in _SEAT_TABLES.items()}
    clock = old["clock"].select("show_id", F.struct("ts", "cmd_id").alias("_last"))
    log = materialize(commands.filter(F.col("show_id").isNotNull()).join(clock, "show_id", "left")
                      .withColumn("_late", F.coalesce(F.struct("ts", "cmd_id") < F.col("_last"), F.lit(False))), "t1-batch")
    on_time = log.filter("not _late").select([f.name for f in COMMAND_SCHEMA.fields])
    changes = materialize(replay_from_state(on_time, old["bookings"], old["seats"].select("show_id", "seat_id", "is_available")), "t1-changes")
    left = changes.filter(F.col("kind") == BOOKING).select("show_id", "booking_id", "owner", "booking_status", "seat_ids", "paid")
    done = changes.filter(F.col("kind") != BOOKING)
    events = done.filter("is_available >= 0").select("show_id", F.explode("seat_ids").alias("seat_id"), "is_available", "ts", "cmd_id")
    order = F.struct("ts", "cmd_id")
    new = {
        "bookings": old["bookings"].join(left, ["show_id", "booking_id"], "left_anti").unionByName(left),
        "seats": (old["seats"].unionByName(events).groupBy("show_id", "seat_id")
                  .agg(F.max_by(F.struct("is_available", "ts", "cmd_id"), order).alias("e")).select("show_id", "seat_id", "e.*")),
        "clock": (old["clock"].unionByName(on_time.select("show_id", "ts", "cmd_id")).groupBy("show_id").agg(F.max(order).alias("e"))
                  .select("show_id", "e.*")),
        "outcomes": done.select([f.name for f in OUTCOME_SCHEMA.fields]).unionByName(log.filter("_late").select(
            "show_id", "ts", "cmd_id", "kind", "booking_id", F.lit("LATE").alias("outcome"),
            F.lit(None).cast("string").alias("booking_status"), F.lit(None).cast("string").alias("unavailable_seats"))),
    }
    for table, df in new.items():
        df.write.mode("overwrite").parquet(_version(root, table, epoch))


def stream_seat_upkeep(spark: SparkSession, commands: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """T1 by micro-batches of the component-split replay: the outcome of every command, and (show_id, seat_id, is_available)
    of every seat that a booking took or freed, as its last seat line added (taken) or removed (free) left it."""
    run_available_now(commands.writeStream.foreachBatch(lambda df, epoch: seat_upkeep_batch(spark, df, epoch, root)),
                      os.path.join(root, "_checkpoint"))
    last = latest_version(spark, os.path.join(root, "outcomes"))
    if last is None:
        return spark.createDataFrame([], OUTCOME_SCHEMA), spark.createDataFrame([], "show_id long, seat_id long, is_available int")
    outcomes = spark.read.schema(OUTCOME_SCHEMA).parquet(*[_version(root, "outcomes", e) for e in range(last + 1)])
    return outcomes, spark.read.schema(_SEAT_TABLES["seats"]).parquet(_version(root, "seats", last)).select("show_id", "seat_id", "is_available")


# --------------------------------------------------------------------------
# Running aggregates per show
# --------------------------------------------------------------------------
def stream_avg_rating(reviews: DataFrame) -> DataFrame:
    """Running sum and count of ratings per show (state: one row per show)."""
    return reviews.groupBy("show_id").agg(F.sum("rating").alias("rating_sum"), F.count(F.lit(1)).alias("review_count"))


def avg_from_running(running: DataFrame) -> DataFrame:
    return running.select("show_id", rating_round(F.col("rating_sum"), F.col("review_count")).alias("avg_rating"),
                          F.col("review_count").cast("long").alias("review_count"))


def stream_revenue(bookings: DataFrame) -> DataFrame:
    """T6 over a feed in which every booking comes once, with its final status: running confirmed revenue and booking
    count per show (state: one row per show).  A feed of status changes: ``keyed.stream_revenue_changes``."""
    return (bookings.filter(F.col("booking_status") == "CONFIRMED").groupBy("show_id")
            .agg(F.sum("total_amount").cast("decimal(18,2)").alias("revenue"), F.count(F.lit(1)).alias("bookings")))


# --------------------------------------------------------------------------
# Request windows per client
# --------------------------------------------------------------------------
def stream_request_windows(events: DataFrame, api_limit: int = API_LIMIT, auth_limit: int = AUTH_LIMIT,
                           window: str = LIMIT_WINDOW, watermark: str = "10 minutes") -> DataFrame:
    """Requests per client and fixed window, for the API scope (every event) and
    the auth scope (sign-ups), with the limit and whether it was exceeded.  Append
    mode: a window is emitted once, when the watermark passes its end, and its
    state is dropped then."""
    scoped = events.withColumn("scope", F.explode(F.when(F.col("event_type") == "signup", F.array(F.lit("api"), F.lit("auth")))
                                                  .otherwise(F.array(F.lit("api")))))
    agg = (_event_time(scoped, "ts", watermark).groupBy(F.window("_et", window), "user_id", "scope")
           .agg(F.count(F.lit(1)).alias("requests")))
    lim = F.when(F.col("scope") == "auth", F.lit(auth_limit)).otherwise(F.lit(api_limit))
    return agg.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                      "user_id", "scope", "requests", lim.alias("request_limit"), (F.col("requests") > lim).alias("over_limit"))


def request_windows_batch(events: DataFrame, api_limit: int = API_LIMIT, auth_limit: int = AUTH_LIMIT,
                          window: str = LIMIT_WINDOW) -> DataFrame:
    """Batch form of T3 over a static table (same windows, no watermark)."""
    scoped = events.withColumn("scope", F.explode(F.when(F.col("event_type") == "signup", F.array(F.lit("api"), F.lit("auth")))
                                                  .otherwise(F.array(F.lit("api")))))
    agg = scoped.groupBy(F.window(F.col("ts").cast("timestamp"), window), "user_id", "scope").agg(F.count(F.lit(1)).alias("requests"))
    lim = F.when(F.col("scope") == "auth", F.lit(auth_limit)).otherwise(F.lit(api_limit))
    return agg.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                      "user_id", "scope", "requests", lim.alias("request_limit"), (F.col("requests") > lim).alias("over_limit"))


# --------------------------------------------------------------------------
# T4: seat holds that expire unconfirmed
# --------------------------------------------------------------------------
def stream_hold_expiry(holds: DataFrame, confirms: DataFrame, hold: str = HOLD_LENGTH,
                       watermark: str = "10 minutes") -> DataFrame:
    """T4: a hold (a `view`) expires unless the same client confirms (a `purchase`)
    within ``hold``.  Stream-stream left outer join with a time range: the
    watermarks bound both sides' state; unmatched holds are emitted as expired
    once the watermark passes hold + ``hold``."""
    h = _event_time(holds.select(F.col("event_id").alias("hold_id"), F.col("user_id").alias("h_user"),
                                 F.col("ts").alias("hold_ts")), "hold_ts", watermark).withColumnRenamed("_et", "h_et")
    c = _event_time(confirms.select(F.col("event_id").alias("confirm_id"), F.col("user_id").alias("c_user"),
                                    F.col("ts").alias("confirm_ts")), "confirm_ts", watermark).withColumnRenamed("_et", "c_et")
    # time bins of the hold's length: a confirmation can only meet holds of its own bin and the one before,
    # so a busy client's views and purchases are dealt out by bin
    h = h.withColumn("h_bin", F.window("h_et", hold).start)
    c = c.withColumn("c_bin", F.explode(F.array(F.window("c_et", hold).start, F.window("c_et", hold).start - F.expr(f"INTERVAL {hold}"))))
    cond = ((F.col("h_user") == F.col("c_user")) & (F.col("h_bin") == F.col("c_bin")) & (F.col("c_et") >= F.col("h_et"))
            & (F.col("c_et") <= F.col("h_et") + F.expr(f"INTERVAL {hold}")))
    j = h.join(c, cond, "leftOuter")
    return j.filter(F.col("confirm_id").isNull()).select("hold_id", F.col("h_user").alias("user_id"), "hold_ts")


def hold_expiry_batch(events: DataFrame, hold: str = HOLD_LENGTH) -> DataFrame:
    """Batch form of T4: holds with no confirmation by the client within ``hold``."""
    h = events.filter(F.col("event_type") == "view").select(F.col("event_id").alias("hold_id"), F.col("user_id").alias("h_user"),
                                                           F.col("ts").alias("hold_ts"))
    c = events.filter(F.col("event_type") == "purchase").select(F.col("user_id").alias("c_user"), F.col("ts").alias("confirm_ts"))
    cond = ((F.col("h_user") == F.col("c_user")) & (F.col("confirm_ts") >= F.col("hold_ts"))
            & (F.col("confirm_ts") <= F.col("hold_ts") + F.expr(f"INTERVAL {hold}")))
    return h.join(c, cond, "left_anti").select("hold_id", F.col("h_user").alias("user_id"), "hold_ts")


# --------------------------------------------------------------------------
# T5: reminder run with a sent log
# --------------------------------------------------------------------------
def run_reminders(st: dict, as_of, log_path: str, outbox_path: str | None = None) -> DataFrame:
    """T5: the hourly job, idempotent: reminders due minus those already in the sent
    log are appended to the log (and the outbox); returns the newly sent rows.
    A crash between the two writes re-sends nothing: the log is the source of truth."""
    spark = st["bookings"].sparkSession
    if exists(spark, log_path):  # what was sent leaves before its seats are looked up
        st = copy(st)
        st["bookings"] = st["bookings"].join(spark.read.parquet(log_path).select("booking_id"), "booking_id", "left_anti")
    due = reminders_due(st, as_of)
    new = materialize(due.withColumn("sent_as_of", F.lit(str(as_of)).cast("timestamp_ntz")), "reminders-due")
    if outbox_path:
        outbox_sink(outbox_messages(new, "reminder"), outbox_path)
    new.select("booking_id", "user_id", "email", "show_id", "sent_as_of").write.mode("append").parquet(log_path)
    return new


# --------------------------------------------------------------------------
# Messages after commits
# --------------------------------------------------------------------------
def stream_registrations(users: DataFrame, watermark: str = "1 day") -> DataFrame:
    """A welcome message per new user; a user seen again within the watermark is not welcomed twice."""
    return outbox_messages(_event_time(users, "created_at", watermark).dropDuplicatesWithinWatermark(["user_id"]), "welcome")


def stream_outbox(bookings: DataFrame, st: dict, watermark: str = "1 day") -> DataFrame:
    """A confirmation message per CONFIRMED booking and a cancellation message per
    CANCELLED one, built by stream-static joins (users, shows, pre-aggregated seat
    lists); duplicates of a message id within the watermark are dropped."""
    from marquee.operators.documents import booking_seat_lines
    seats = (booking_seat_lines(st).groupBy("booking_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("row_letter", "seat_number", "seat_type"))),
        lambda s: F.concat(s["row_letter"], s["seat_number"].cast("string"), F.lit("("), s["seat_type"], F.lit(")"))),
        ", ").alias("seat_list")))
    # a static side is computed anew in every micro-batch: what does not change with the stream is written once
    seats, users, shows = (materialize(df, f"t7-{name}") for name, df in (
        ("seats", seats), ("users", st["users"].select("user_id", "email")), ("shows", st["shows"].select("show_id", "title"))))
    b = (_event_time(bookings, "booking_date", watermark).dropDuplicatesWithinWatermark(["booking_id", "booking_status"])
         .join(users, "user_id").join(shows, "show_id"))
    conf = outbox_messages(b.filter(F.col("booking_status") == "CONFIRMED").join(seats, "booking_id", "left")
                           .withColumn("seat_list", F.coalesce("seat_list", F.lit(""))), "confirmation")
    canc = outbox_messages(b.filter(F.col("booking_status") == "CANCELLED"), "cancellation")
    return conf.unionByName(canc)


# --------------------------------------------------------------------------
# batch drivers used by the registered queries
# --------------------------------------------------------------------------
def stream_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run ``stream`` to completion into Parquet under the checkpoint dir; read the result back.
    ``append`` uses the exactly-once file sink; ``complete`` writes a version per batch."""
    base = scratch_dir(spark, name)
    out, ck = os.path.join(base, "out"), os.path.join(base, "_checkpoint")
    if mode == "append":
        run_available_now(stream.writeStream.outputMode("append").format("parquet").option("path", out), ck)
    else:
        def version(df, epoch):  # a failed write leaves the version before it whole
            df.write.mode("overwrite").parquet(_version(base, "out", epoch))
        run_available_now(stream.writeStream.outputMode(mode).foreachBatch(version), ck)
        last = latest_version(spark, out)
        return spark.createDataFrame([], stream.schema) if last is None else spark.read.schema(stream.schema).parquet(_version(base, "out", last))
    return spark.read.schema(stream.schema).parquet(out)


# --------------------------------------------------------------------------
# T2 with edits: review upserts and deletes, ratings of touched shows
# --------------------------------------------------------------------------
REVIEW_EVENT_FIELDS = ["review_id", "user_id", "show_id", "rating", "comment", "reviewed_at", "op", "event_ts"]


def _version(root: str, table: str, epoch: int | str) -> str:
    return os.path.join(root, table, f"v{epoch}")


RATING_SUMS = "show_id long, rating_sum long, review_count long"


def rating_tables(spark: SparkSession, root: str, buckets: int = 32) -> tuple[BucketTable, BucketTable]:
    """The upkeep's state under ``root``: reviews in buckets of review_id, sums of ratings in buckets of show_id."""
    from marquee.sources.schemas import TABLES
    reviews = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES["reviews"].fields)
    return (BucketTable(spark, os.path.join(root, "reviews"), reviews, ["review_id"], buckets),
            BucketTable(spark, os.path.join(root, "ratings"), RATING_SUMS, ["show_id"], buckets))


def _rating_sums(rows: DataFrame) -> DataFrame:
    """(show_id, rating, n) with n = 1 (a review) or -1 (a review taken back), or sums of such -> one row per show."""
    return rows.groupBy("show_id").agg(F.sum("rating_sum").cast("long").alias("rating_sum"), F.sum("review_count").cast("long").alias("review_count"))


def rating_upkeep_batch(spark: SparkSession, events: DataFrame, epoch: int, root: str) -> None:
    """foreachBatch body.  State: two bucket tables under ``root`` (version 0: the start); batch ``e`` makes version
    e + 1 from the version before, so a retried batch makes the same one again (idempotent).  Per review id the batch's last event
    wins.  Its buckets of reviews are read and written, and the old and the new review of each changed id
    become signed sums (minus the old, plus the new) that are added to their shows' buckets: no other review is touched."""
    reviews, ratings = rating_tables(spark, root)
    fields = [f.strip().split(" ")[0] for f in reviews.schema.split(",")]
    last = materialize(events.groupBy("review_id").agg(F.max_by(F.struct(*[c for c in REVIEW_EVENT_FIELDS if c != "review_id"]), "event_ts").alias("e"))
                       .select("review_id", "e.*"), "t2-events")
    base, here = reviews.latest(epoch + 1), reviews.touched(last)
    old = reviews.read(base, here)
    upserts = last.filter(F.col("op") == "upsert").select(*fields)
    gone = old.join(last.select("review_id"), "review_id", "left_semi")
    changes = gone.select("show_id", (-F.col("rating")).alias("rating_sum"), F.lit(-1).alias("review_count")).unionByName(
        upserts.select("show_id", F.col("rating").alias("rating_sum"), F.lit(1).alias("review_count")))
    sums = materialize(_rating_sums(changes), "t2-sums")
    reviews.write(old.join(last.select("review_id"), "review_id", "left_anti").unionByName(upserts), epoch + 1, here, base)
    base, here = ratings.latest(epoch + 1), ratings.touched(sums)
    ratings.write(_rating_sums(ratings.read(base, here).unionByName(sums)).filter("review_count > 0"), epoch + 1, here, base)


def start_rating_upkeep(spark: SparkSession, reviews: DataFrame, root: str) -> None:
    """Version 0 of the upkeep's state from a table of reviews."""
    table, ratings = rating_tables(spark, root)
    table.write(reviews, 0)
    ratings.write(_rating_sums(reviews.select("show_id", F.col("rating").alias("rating_sum"), F.lit(1).alias("review_count"))), 0)


def ratings_now(spark: SparkSession, root: str) -> DataFrame:
    """(show_id, avg_rating, review_count) of the shows with reviews, as the last finished batch left them."""
    ratings = rating_tables(spark, root)[1]
    return avg_from_running(ratings.read(ratings.latest()))


def stream_rating_upkeep(spark: SparkSession, events: DataFrame, reviews: DataFrame, root: str) -> DataFrame:
    """T2 with edits: start from ``reviews``, apply the event stream (op = 'upsert' | 'delete', keyed by
    review_id, ordered by event_ts) batch by batch, and return the ratings after it.  A root that has a state goes on with it."""
    if rating_tables(spark, root)[1].latest() is None:
        start_rating_upkeep(spark, reviews, root)
    run_available_now(events.writeStream.foreachBatch(lambda df, epoch: rating_upkeep_batch(spark, df, epoch, root)), os.path.join(root, "_checkpoint"))
    return ratings_now(spark, root)
