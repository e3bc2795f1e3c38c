"""Booking-shaped state over the driver's TPC-H-like tables (FIXTURES.md section 3).

Every table is a lazy DataFrame derived from the parquet scans, so its size grows
with the input and Catalyst prunes the columns each query needs.  Ids are derived
from natural keys (never ``monotonically_increasing_id``), so the same input
always gives the same ids on any cluster layout.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.sources.schemas import conform

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()

SHOWS_PER_TASK = 2000  # shows whose seats (hundreds each) one task makes

# Fixed values of the mapping (FIXTURES.md section 3).
SEAT_ROWS, SEATS_PER_ROW, VIP_ROWS, PREMIUM_ROWS = 7, 48, 1, 1
VIP_PRICE, PREMIUM_PRICE, REGULAR_PRICE = Decimal("1200"), Decimal("800"), Decimal("500")
STATUS_OF = {"F": "CONFIRMED", "O": "PENDING", "P": "CANCELLED"}
METHOD_OF_PRIORITY = {"1": "UPI", "2": "Debit Card", "3": "Net Banking", "4": "Credit Card", "5": "UPI"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(col, mapping: dict, default=None):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


class DriverData:
    """Raw driver tables of one scale directory, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]


def _show_of_order(orders: DataFrame, part: DataFrame):
    """show_id = o_orderkey % np - o_orderkey % 2, np = count(part) as a scalar subquery."""
    np_ = part.select(F.count(F.lit(1))).scalar()
    k = F.col("o_orderkey")
    return (k % np_ - k % 2).cast("long")


def mapped_bookings(d: DriverData) -> DataFrame:
    o = d["orders"]
    k = F.col("o_orderkey")
    return o.select(
        k.alias("booking_id"), F.col("o_custkey").alias("user_id"),
        _show_of_order(o, d["part"]).alias("show_id"),
        F.timestamp_add("MINUTE", k % 1440, F.col("o_orderdate")).alias("booking_date"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("total_amount"),
        _case(F.col("o_orderstatus"), STATUS_OF, "CANCELLED").alias("booking_status"),
        (k % 4 == 0).cast("int").alias("reminder_sent"),
        F.substring("o_orderpriority", 1, 1).alias("_prio"),
    )


class BookingState(dict):
    """Tables by name; a table given as a function is built when first asked for."""

    def __getitem__(self, name):
        table = super().__getitem__(name)
        if not isinstance(table, DataFrame):
            table = self[name] = table()
        return table

    def __copy__(self) -> BookingState:
        out = BookingState()
        for name in self:
            dict.__setitem__(out, name, dict.__getitem__(self, name))
        return out


def booking_state(spark: SparkSession, sf_dir: str, with_availability: bool = True) -> dict:
    """The eleven booking tables over the driver data of ``sf_dir``."""
    from marquee.operators.analytics import avg_rating
    from marquee.operators.seatmap import seat_grid

    d = DriverData(spark, sf_dir)
    st = BookingState()

    c = d["customer"]
    st["users"] = conform(c.select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name"),
        F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.test")).alias("email"),
        F.lit("").alias("password_hash"), (F.col("c_custkey") % 100 == 0).alias("is_admin"),
        F.date_add(F.lit("1994-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int"))
         .cast("timestamp_ntz").alias("created_at")), "users")

    # nation and region are fixed 25- and 5-row dimensions: the broadcast is bounded
    st["venues"] = conform(d["nation"].join(F.broadcast(d["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
                           .select(F.col("n_nationkey").alias("venue_id"), F.col("n_name").alias("venue_name"),
                                   F.col("n_name").alias("city"), F.col("r_name").alias("state"),
                                   (F.lit(1000) + 100 * F.col("n_nationkey")).alias("capacity"),
                                   F.col("n_name").alias("address")), "venues")

    # category ids number the distinct part types by name; the window runs over the
    # distinct names only (one row per type), never over the part table itself
    types = d["part"].select("p_type").distinct()
    st["categories"] = conform(types.select(
        F.row_number().over(Window.orderBy("p_type")).alias("category_id"),
        F.col("p_type").alias("category_name"), F.lit(None).cast("string").alias("description")), "categories")

    b = mapped_bookings(d)
    st["bookings"] = conform(b, "bookings")

    # reviews: confirmed bookings with id % 3 = 0, the smallest booking per (user, show)
    first = (b.filter((F.col("booking_status") == "CONFIRMED") & (F.col("booking_id") % 3 == 0))
             .groupBy("user_id", "show_id")
             .agg(F.min(F.struct("booking_id", "booking_date")).alias("f"))
             .select("user_id", "show_id", F.col("f.booking_id").alias("booking_id"),
                     F.col("f.booking_date").alias("booking_date")))
    bid = F.col("booking_id")
    st["reviews"] = conform(first.select(
        bid.alias("review_id"), "user_id", "show_id",
        (F.lit(1) + F.floor(bid / 7) % 5).cast("int").alias("rating"),
        F.when(bid % 2 == 0, F.lit(None)).otherwise(F.concat(F.lit("Review of booking "), bid.cast("string")))
         .alias("comment"),
        F.timestamp_add("DAY", F.lit(30), F.col("booking_date")).alias("reviewed_at")), "reviews")

    p = d["part"]
    shows0 = (p.join(st["categories"].select("category_id", F.col("category_name").alias("p_type")), "p_type")
              .select(F.col("p_partkey").alias("show_id"), F.col("p_name").alias("title"),
                      F.lit(None).cast("string").alias("description"),
                      F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 2400).cast("int")).alias("show_date"),
                      F.lit("18:00:00").alias("show_time"), (F.col("p_size") % 25).cast("long").alias("venue_id"),
                      "category_id", F.col("p_retailprice").cast("decimal(10,2)").alias("base_price")))
    rated = avg_rating({"reviews": st["reviews"], "shows": shows0})
    st["shows"] = conform(shows0.join(rated.select("show_id", "avg_rating"), "show_id", "left")
                          .withColumn("avg_rating", F.coalesce("avg_rating", F.lit(Decimal("0.00")))), "shows")

    # seat lines: distinct (booking, seat) of lines of non-cancelled bookings, quantity <= 48
    li = d["lineitem"]
    live = b.filter(F.col("booking_status") != "CANCELLED").select("booking_id", "show_id")
    lines = (li.filter(F.col("l_quantity") <= SEATS_PER_ROW)
             .select(F.col("l_orderkey").alias("booking_id"), "l_linenumber", "l_quantity")
             .join(live, "booking_id")
             .select("booking_id", "show_id",
                     (F.col("show_id") * 1000 + (F.col("l_linenumber") - 1) * 100
                      + F.col("l_quantity").cast("long")).alias("seat_id"))
             .distinct())
    st["booking_seats"] = conform(lines.withColumn("bs_id", F.col("booking_id") * 1000 + F.col("seat_id") % 1000),
                                  "booking_seats")

    s = d["supplier"]
    st["food_items"] = conform(s.select(
        F.col("s_suppkey").alias("food_id"), F.col("s_name").alias("food_name"),
        (F.lit(10) * (F.lit(1) + F.col("s_suppkey") % 20)).alias("price"),
        (F.col("s_suppkey") % 4 != 0).cast("int").alias("is_veg")), "food_items")

    # booking_food ids: order key * 100 + position among that order's 'R' lines
    wline = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    st["booking_food"] = conform(li.filter(F.col("l_returnflag") == "R").select(
        (F.col("l_orderkey") * 100 + F.row_number().over(wline)).alias("bf_id"),
        F.col("l_orderkey").alias("booking_id"), F.col("l_suppkey").alias("food_id"),
        F.col("l_linenumber").alias("quantity")), "booking_food")

    status = F.col("booking_status")
    st["payments"] = conform(
        b.filter((status != "CANCELLED") | (F.col("booking_id") % 2 == 0)).select(
            F.col("booking_id").alias("payment_id"), "booking_id", F.col("total_amount").alias("amount"),
            _case(F.col("_prio"), METHOD_OF_PRIORITY, "UPI").alias("payment_method"),
            _case(status, {"CONFIRMED": "SUCCESS", "PENDING": "PENDING"}, "FAILED").alias("payment_status"),
            F.when(status == "CONFIRMED", F.timestamp_add("MINUTE", F.lit(5), F.col("booking_date"))).alias("paid_at")),
        "payments")

    # seat maps depend only on the show ids: generate them from the part-derived shows,
    # so the plan of ``seats`` never carries the rating aggregate over the orders
    specs = shows0.select(
        "show_id", F.lit(SEAT_ROWS).alias("n_rows"), F.lit(SEATS_PER_ROW).alias("seats_per_row"),
        F.lit(VIP_ROWS).alias("vip_rows"), F.lit(PREMIUM_ROWS).alias("premium_rows"),
        F.lit(VIP_PRICE).alias("vip_price"), F.lit(PREMIUM_PRICE).alias("premium_price"),
        F.lit(REGULAR_PRICE).alias("regular_price"))

    def seats() -> DataFrame:
        # a show's taken seat ids (at most its 336 seats) meet its spec, and one narrow explode makes the
        # rows, of the columns that are asked for.  The optimizer takes an explode for as small as its input, so the
        # hint keeps joins from broadcasting the table; nothing is written for queries that only read it.
        # The specs are small and their seats are not, so the shows are dealt to tasks by their number: sized by the
        # specs' bytes, a few tasks would make all seats, and sort and spill them in what follows.
        n = max(spark.sparkContext.defaultParallelism, -(-p.count() // SHOWS_PER_TASK))
        taken = lines.groupBy("show_id").agg(F.collect_set("seat_id").alias("_taken"))
        held_by = specs.join(taken, "show_id", "left") if with_availability else specs.withColumn("_taken", F.lit(None))
        grid = seat_grid(held_by.repartition(n, "show_id"), "_taken")
        sid = F.col("show_id") * 1000 + (F.col("row_no") - 1) * 100 + F.col("seat_number")
        held = F.coalesce(F.array_contains("_taken", sid), F.lit(False)) if with_availability else F.lit(False)
        return conform(grid.withColumn("seat_id", sid).withColumn("is_available", F.when(held, 0).otherwise(1)), "seats").hint("merge")

    dict.__setitem__(st, "seats", seats)
    return st


def broken_state(spark: SparkSession, sf_dir: str) -> dict:
    """The mapped tables with every kind of violation planted in some rows of each (audits Q1-Q5)."""
    st = booking_state(spark, sf_dir)

    def alter(table: str, **cols):
        """Column -> (key, modulus, remainder, value) or several of them.  A row of ``again`` also comes once more as it
        was: it is doubled where it is made, so the table is made once."""
        out = st[table]
        if table in again:
            key, m, r = again[table]
            twice = F.coalesce(F.col(key) % m == r, F.lit(False))
            out = out.withColumn("_as_was", F.explode(F.when(twice, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        for col, rules in cols.items():
            value = F.col(col)
            for key, m, r, new in reversed(rules if isinstance(rules, list) else [rules]):
                value = F.when(F.col(key) % m == r, new).otherwise(value)
            value = F.when(F.col("_as_was"), F.col(col)).otherwise(value) if table in again else value
            cols[col] = value.cast(st[table].schema[col].dataType)
        return out.withColumns(cols).drop("_as_was")

    none, minus = F.lit(None), F.lit(-1)
    again = {"seats": ("seat_id", 8000, 4), "booking_seats": ("booking_id", 500, 1), "booking_food": ("booking_id", 450, 3),
             "payments": ("booking_id", 550, 5), "reviews": ("review_id", 120, 3)}
    capitals = st["categories"].filter("category_id % 50 = 1").withColumns(
        {"category_id": F.col("category_id") + 1000000, "category_name": F.upper("category_name")})
    c = F.col
    new = {
        "venues": alter("venues", capacity=("venue_id", 10, 1, F.lit(0)), address=("venue_id", 12, 5, none)),
        "categories": st["categories"].unionByName(capitals),
        "users": alter("users", email=("user_id", 50, 1, F.concat(F.lit("U"), (c("user_id") + 1).cast("string"), F.lit("@Example.TEST"))),
                       full_name=("user_id", 40, 3, none)),
        "shows": alter("shows", venue_id=("show_id", 30, 1, c("venue_id") + 1000), category_id=("show_id", 30, 7, minus),
                       base_price=("show_id", 25, 2, minus), avg_rating=("show_id", 35, 6, F.lit(9.5)), title=("show_id", 45, 4, none)),
        "seats": alter("seats", seat_type=("seat_id", 5000, 1, F.lit("BALCONY")), price=("seat_id", 7000, 2, minus),
                       show_id=("seat_id", 9000, 3, -c("show_id") - 1)),
        "bookings": alter("bookings", user_id=("booking_id", 300, 4, F.lit(-5)), show_id=("booking_id", 300, 8, F.lit(-6)),
                          total_amount=("booking_id", 250, 6, minus),
                          booking_status=[("booking_id", 200, 3, F.lit("LOST")), ("booking_id", 210, 9, none)]),
        "booking_seats": alter("booking_seats", booking_id=("booking_id", 400, 12, -c("booking_id")), seat_id=("booking_id", 400, 5, -c("seat_id"))),
        "food_items": alter("food_items", price=("food_id", 10, 1, minus)),
        "booking_food": alter("booking_food", booking_id=("booking_id", 350, 13, -c("booking_id")), food_id=("booking_id", 350, 2, F.lit(-7)),
                              quantity=("booking_id", 300, 1, F.lit(0))),
        "payments": alter("payments", booking_id=("booking_id", 600, 14, -c("booking_id")), amount=("booking_id", 260, 4, minus),
                          payment_method=("booking_id", 170, 2, none), payment_status=("booking_id", 150, 1, F.lit("UNKNOWN"))),
        "reviews": alter("reviews", user_id=("review_id", 110, 7, F.lit(-8)), show_id=("review_id", 110, 9, F.lit(-9)), rating=("review_id", 100, 3, F.lit(9))),
    }
    return new
