"""Due notifications and the outbox.

"Now" is always an ``as_of`` argument, never ``current_timestamp()``, so a run is
reproducible and any scheduler can drive it.  The reference wraps the date column
in DATE(), which defeats its index; here the date column is compared directly
so the predicate reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import seat_labels_agg
from marquee.plans.lineage import materialize
from marquee.plans.paths import exists
from marquee.sources.schemas import conform

SENT_LINES = 200_000  # seat lines (two longs each) that may be sent to every executor

# Fixed message formats of the reference (subjects and bodies); the brand name is ours to set.
BRAND = "Box Office"
SUBJECTS = {
    "welcome": "Welcome to {brand}!",
    "confirmation": "Booking Confirmed – {title}",
    "cancellation": "Booking Cancelled – {title}",
    "reminder": "Reminder: {title} is tomorrow!",
}
BODIES = {
    "welcome": "<h2>Welcome, {full_name}!</h2><p>Your account is ready.</p>",
    "confirmation": "<h2>Booking #{booking_id} Confirmed</h2><p>Seats: {seat_list}</p><p>Total: ₹{total_amount}</p>",
    "cancellation": "<h2>Booking #{booking_id} Cancelled</h2>",
    "reminder": "<h2>See you tomorrow at {title}!</h2>",
    "bulk": "<h3>{subject}</h3><p>{message}</p><p>– Team {brand}</p>",
}


def _as_date(as_of) -> F.Column:
    return F.to_date(F.lit(str(as_of)))


def reminders_due(st: dict, as_of) -> DataFrame:
    """Hourly job (J14, P10, P11): CONFIRMED bookings of shows dated the day after
    ``as_of`` whose reminder is unset, one row per booking with its seat labels.
    Bookings without seat lines drop out (inner join), as in the reference."""
    day = F.date_add(_as_date(as_of), 1)
    shows = st["shows"].filter(F.col("show_date") == day).select("show_id", "title", "show_date", "show_time", "venue_id")
    b = (st["bookings"].filter((F.col("booking_status") == "CONFIRMED")
                               & (F.coalesce(F.col("reminder_sent"), F.lit(0)) == 0))
         .join(shows, "show_id"))
    # the day's seat lines are few and the seats are not: written, the lines are small enough to be sent to the seats
    # where these are made; more than that many lines are hashed by task, and the seats pass by them unsorted
    lines = materialize(st["booking_seats"].join(b.select("booking_id"), "booking_id", "left_semi").select("booking_id", "seat_id"), "reminder-lines")
    lines = F.broadcast(lines) if lines.limit(SENT_LINES + 1).count() <= SENT_LINES else lines.hint("shuffle_hash")
    labels = (lines.join(st["seats"].select("seat_id", "row_letter", "seat_number").hint("shuffle_replicate_nl"), "seat_id")
              .groupBy("booking_id").agg(seat_labels_agg().alias("seat_labels")))
    return (b.join(st["users"].select("user_id", "full_name", "email"), "user_id")
            .join(st["venues"].select("venue_id", "venue_name", "city"), "venue_id")
            .join(labels, "booking_id")
            .select("booking_id", "total_amount", "user_id", "full_name", "email", "show_id", "title",
                    "show_date", "show_time", "venue_name", "city", "seat_labels"))


def review_requests_due(st: dict, as_of) -> DataFrame:
    """Daily job (J7): CONFIRMED bookings of shows dated the day before ``as_of``
    with no review by that user of that show (anti join on (user, show))."""
    day = F.date_sub(_as_date(as_of), 1)
    shows = st["shows"].filter(F.col("show_date") == day).select("show_id", "title")
    return (st["bookings"].filter(F.col("booking_status") == "CONFIRMED").join(shows, "show_id")
            .join(st["reviews"].select("user_id", "show_id"), ["user_id", "show_id"], "left_anti")
            .join(st["users"].select("user_id", "full_name", "email"), "user_id")
            .select("booking_id", "total_amount", "user_id", "full_name", "email", "show_id", "title"))


def mark_reminded(st: dict, sent: DataFrame) -> DataFrame:
    """reminder_sent = 1 for the bookings in ``sent`` (booking_id).  Returns the new bookings table."""
    keys = sent.select("booking_id").distinct().withColumn("_sent", F.lit(1))
    return conform(st["bookings"].join(keys, "booking_id", "left")
                   .withColumn("reminder_sent", F.when(F.col("_sent") == 1, F.lit(1)).otherwise(F.col("reminder_sent"))),
                   "bookings")


def _fmt(template: str, **cols) -> F.Column:
    """Template text with {name} holes filled by columns (JVM-side concat)."""
    parts, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if pre:
            parts.append(F.lit(pre))
        parts.append(cols[name].cast("string"))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)


def wrap_html(body: F.Column, brand: str = BRAND) -> F.Column:
    """The body as a section under the brand's name."""
    return F.concat(F.lit(f"<section><header>{brand}</header>"), body, F.lit("</section>"))


def outbox_messages(df: DataFrame, kind: str, subject: str | None = None, message: str | None = None,
                    brand: str = BRAND, mailing: str | None = None) -> DataFrame:
    """one message row (to, subject, html, template, message_id) per input row.

    welcome: users rows; confirmation: booking rows with email, title, booking_id,
    total_amount and seat_list; cancellation: booking rows with email, title,
    booking_id; reminder: ``reminders_due`` rows; bulk: users rows plus the
    admin's subject and message (both required).

    A message's id is its kind and its booking or user; a bulk message's id also has its mailing, by default
    a digest of subject and message: another mailing is sent to the same users, the same one is not sent twice
    unless it is given a ``mailing`` name of its own."""
    c = {k: F.col(k) for k in df.columns}
    c["brand"] = F.lit(brand)
    if kind == "bulk":
        if not subject or not message:
            raise ValueError("subject and message required")
        c["subject"], c["message"] = F.lit(subject), F.lit(message)
        subj = F.lit(subject)
        kind_id = F.concat_ws(":", F.lit(kind), F.lit(mailing) if mailing else F.substring(F.sha2(F.concat_ws("\n", c["subject"], c["message"]), 256), 1, 16))
    else:
        kind_id = F.lit(kind)
        subj = _fmt(SUBJECTS[kind], **c)
    key = F.col("booking_id") if "booking_id" in df.columns else F.col("user_id")
    return df.select(F.col("email").alias("to"), subj.alias("subject"),
                     wrap_html(_fmt(BODIES[kind], **c), brand).alias("html"),
                     F.lit(kind).alias("template"),
                     F.concat_ws(":", kind_id, key.cast("string")).alias("message_id"))


def confirmations(st: dict, bookings: DataFrame) -> DataFrame:
    """What a confirmation message needs of CONFIRMED ``bookings`` (rows of the booking table): address, title, seat list."""
    from marquee.operators.documents import booking_seat_lines
    label = F.transform(F.array_sort(F.collect_list(F.struct("row_letter", "seat_number", "seat_type"))),
                        lambda s: F.concat(s["row_letter"], s["seat_number"].cast("string"), F.lit("("), s["seat_type"], F.lit(")")))
    seats = booking_seat_lines(st).groupBy("booking_id").agg(F.array_join(label, ", ").alias("seat_list"))  # a booking's seats
    return (bookings.filter(F.col("booking_status") == "CONFIRMED").join(st["users"].select("user_id", "email"), "user_id")
            .join(st["shows"].select("show_id", "title"), "show_id").join(seats, "booking_id", "left")
            .withColumn("seat_list", F.coalesce("seat_list", F.lit(""))))


def outbox_sink(messages: DataFrame, path: str) -> None:
    """Append messages to an outbox table partitioned by template (idempotent
    by message_id: rows already in the outbox, and repeats within the batch, are not
    appended).  The first run finds no table; any other read error is raised."""
    if exists(messages.sparkSession, path):
        sent = messages.sparkSession.read.parquet(path).select("template", "message_id")
        messages = messages.join(sent, ["template", "message_id"], "left_anti")
    messages.dropDuplicates(["message_id"]).write.mode("append").partitionBy("template").parquet(path)
