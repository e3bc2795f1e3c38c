"""Seat-map generation (M10), seat maps (A11) and availability refresh."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.plans.ids import assign_ids
from marquee.sources.schemas import conform

# Fixed values of the reference's seat-map procedure and controller.
MAX_ROWS = 26
DEFAULTS = {"n_rows": 5, "seats_per_row": 10, "vip_rows": 1, "premium_rows": 1,
            "vip_price": Decimal("1200"), "premium_price": Decimal("800"),
            "regular_price": Decimal("500")}


def seat_map_specs(specs: DataFrame) -> DataFrame:
    """Apply the controller's defaults: an absent or 0 parameter takes the default."""
    out = specs
    for k, v in DEFAULTS.items():
        c = F.col(k)
        out = out.withColumn(k, F.when(c.isNull() | (c == 0), F.lit(v)).otherwise(c))
    return out.withColumn("n_rows", F.col("n_rows").cast("int")) \
              .withColumn("seats_per_row", F.col("seats_per_row").cast("int"))


def seat_grid(specs: DataFrame, *keep: str) -> DataFrame:
    """The seats of each (valid, defaulted) spec without ids: row_no, row letter chr(64 + row), number,
    type by row band (rows <= vip are VIP, the next premium_rows PREMIUM, the rest REGULAR) and price.
    One narrow explode per show; ``keep`` names further spec columns to carry."""
    grid = (specs.withColumn("row_no", F.explode(F.sequence(F.lit(1), F.least(F.col("n_rows"), F.lit(MAX_ROWS)))))
                 .withColumn("seat_number", F.explode(F.sequence(F.lit(1), F.col("seats_per_row")))))
    vip = F.col("row_no") <= F.col("vip_rows")
    prem = F.col("row_no") <= (F.col("vip_rows") + F.col("premium_rows"))
    return grid.select(
        F.col("show_id").cast("long").alias("show_id"), F.col("row_no").cast("long").alias("row_no"),
        F.expr("chr(64 + row_no)").alias("row_letter"), F.col("seat_number").cast("int").alias("seat_number"),
        F.when(vip, "VIP").when(prem, "PREMIUM").otherwise("REGULAR").alias("seat_type"),
        F.lit(1).alias("is_available"),
        F.when(vip, F.col("vip_price")).when(prem, F.col("premium_price"))
         .otherwise(F.col("regular_price")).cast("decimal(10,2)").alias("price"), *keep)


def generate_seat_map(st: dict, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the seats of each show in ``specs`` with a generated grid.

    Returns ``(new_seats, outcomes)``.  Unknown show or rows/per_row < 1 is an
    error outcome; rows are capped at 26.  New seat ids continue the largest
    existing id (replaced seats included) in (show, row, number) order, so they
    are unique whatever the rows and seats per row; kept seats keep theirs.
    """
    sp = seat_map_specs(specs)
    known = sp.join(st["shows"].select("show_id"), "show_id", "left_semi")
    outcome = (
        sp.join(st["shows"].select("show_id", F.lit(True).alias("_known")), "show_id", "left")
        .select("show_id",
                F.when(F.col("_known").isNull(), F.lit("NOT_FOUND"))
                 .when((F.col("n_rows") < 1) | (F.col("seats_per_row") < 1), F.lit("INVALID"))
                 .otherwise(F.lit("GENERATED")).alias("outcome"),
                F.when(F.col("_known").isNotNull() & (F.col("n_rows") >= 1) & (F.col("seats_per_row") >= 1),
                       F.least(F.col("n_rows"), F.lit(MAX_ROWS)) * F.col("seats_per_row"))
                 .otherwise(F.lit(0)).alias("seats_generated"))
    )
    ok = known.filter((F.col("n_rows") >= 1) & (F.col("seats_per_row") >= 1))
    start = st["seats"].select(F.coalesce(F.max("seat_id"), F.lit(0))).scalar() if "seats" in st else 0
    # assign_ids writes the numbered grid once: its size is a file size, so it is broadcast only if really small
    new = conform(assign_ids(seat_grid(ok), ["show_id", "row_no", "seat_number"], start, "seat_id"), "seats")
    kept = st["seats"].join(ok.select("show_id"), "show_id", "left_anti") if "seats" in st else None
    seats = new if kept is None else conform(kept, "seats").unionByName(new)
    return seats, outcome


def refresh_availability(st: dict) -> DataFrame:
    """Batch form of the seat-line triggers.

    is_available = 0 for every seat that has a line of a non-CANCELLED booking,
    1 otherwise.  The live seat ids are deduplicated (partial aggregate) before
    the left join, so a seat held by many lines cannot fan rows out.
    """
    live = (st["booking_seats"].join(
                st["bookings"].filter(F.col("booking_status") != "CANCELLED").select("booking_id"),
                "booking_id", "left_semi")
            .select("seat_id").distinct().withColumn("_taken", F.lit(1)))
    return conform(
        st["seats"].drop("is_available").join(live, "seat_id", "left")
        .withColumn("is_available", F.when(F.col("_taken").isNull(), 1).otherwise(0)),
        "seats")


def seat_map(st: dict, show_ids: DataFrame | None = None) -> DataFrame:
    """Seats of each show grouped by row (A11): one row per show with a
    ``map<row_letter, array<seat>>`` in seat order plus total/available/booked.
    Rows are grouped per (show, row) first, so no single group is larger than one row of seats.
    """
    seats = st["seats"]
    shows = st["shows"].select("show_id", F.col("title").alias("show_title"))
    if show_ids is not None:
        shows = shows.join(show_ids.select("show_id").distinct(), "show_id", "left_semi")
    per_row = (seats.groupBy("show_id", "row_letter")
               .agg(F.array_sort(F.collect_list(F.struct(
                   "seat_number", "seat_id", "seat_type", "is_available", "price"))).alias("seats"),
                    F.count("*").alias("n"), F.sum("is_available").alias("a")))
    per_show = (per_row.groupBy("show_id")
                .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("row_letter", "seats")))).alias("rows"),
                     F.sum("n").alias("total"), F.sum("a").alias("available")))
    return (shows.join(per_show, "show_id", "left")
            .select("show_id", "show_title",
                    F.coalesce("rows", F.create_map().cast("map<string,array<struct<seat_number:int,seat_id:bigint,seat_type:string,is_available:int,price:decimal(10,2)>>>")).alias("rows"),
                    F.coalesce("total", F.lit(0)).cast("long").alias("total"),
                    F.coalesce("available", F.lit(0)).cast("long").alias("available"),
                    (F.coalesce("total", F.lit(0)) - F.coalesce("available", F.lit(0))).cast("long").alias("booked")))


def seat_map_flat(st: dict) -> DataFrame:
    """Flat, comparable form of ``seat_map``: one row per (show, row) with the row's
    seat numbers in order as text, plus the show summary columns."""
    m = seat_map(st)
    return (m.select("show_id", "show_title", "total", "available", "booked", F.explode("rows").alias("row_letter", "seats"))
            .select("show_id", "show_title", "row_letter", "total", "available", "booked",
                    F.size("seats").cast("long").alias("row_seats"),
                    F.array_join(F.transform("seats", lambda s: F.concat(
                        s["seat_number"].cast("string"), F.when(s["is_available"] == 1, F.lit("")).otherwise(F.lit("x")))), " ").alias("row_layout")))
