"""Request tables for the apply jobs, derived from the driver tables.

Booking requests follow FIXTURES.md section 3; the other kinds are derived by
fixed rules from orders, customers and parts, so every request table grows
with the input and contains each rejection case (unknown ids, duplicates,
forbidden actors, invalid values).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.sources.driver import METHOD_OF_PRIORITY, DriverData, _case, mapped_bookings

BAD_FOOD_OFFSET = 100000


def booking_requests(d: DriverData) -> DataFrame:
    """One request per order with lines: requested_at = booking_date, request_id =
    booking_id, seat ids = every line's (row = linenumber, number = quantity) seat
    (repeats and numbers 49-50 kept), food = the 'R' lines (food id + 100000 when
    booking_id % 50 = 0, to make INVALID_FOOD).  Order status is ignored."""
    b = mapped_bookings(d)
    li = d["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_returnflag")
    per_order = (li.join(b.select(F.col("booking_id").alias("l_orderkey"), "show_id"), "l_orderkey")
                 .groupBy("l_orderkey", "show_id")
                 .agg(F.sort_array(F.collect_list(F.struct(
                         "l_linenumber", (F.col("show_id") * 1000 + (F.col("l_linenumber") - 1) * 100
                                          + F.col("l_quantity").cast("long")).alias("sid")))).alias("_s"),
                      F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct(
                          F.col("l_linenumber").alias("_ln"),
                          (F.col("l_suppkey") + F.when(F.col("l_orderkey") % 50 == 0, F.lit(BAD_FOOD_OFFSET))
                           .otherwise(F.lit(0))).alias("food_id"),
                          F.col("l_linenumber").cast("int").alias("quantity"))))).alias("_f")))
    return (per_order.join(b.withColumnRenamed("booking_id", "l_orderkey").drop("show_id"), "l_orderkey")
            .select(F.col("l_orderkey").alias("request_id"), F.col("booking_date").alias("requested_at"),
                    "user_id", "show_id",
                    F.transform("_s", lambda x: x["sid"]).alias("seat_ids"),
                    F.transform("_f", lambda x: F.struct(x["food_id"].alias("food_id"),
                                                         x["quantity"].alias("quantity"))).alias("food"),
                    F.when(F.col("_prio") == "5", F.lit(None).cast("string"))
                     .otherwise(_case(F.col("_prio"), METHOD_OF_PRIORITY, "UPI")).alias("payment_method")))


def review_requests(d: DriverData) -> DataFrame:
    """Every booking (any status) asks to review its show; id % 15 = 0 asks twice (an
    hour apart); id % 33 = 0 gives rating 6 (invalid)."""
    b = mapped_bookings(d)
    copies = F.explode(F.when(F.col("booking_id") % 15 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    bid = F.col("booking_id")
    return (b.select("*", copies.alias("_copy"))
            .select((bid * 10 + F.col("_copy")).alias("request_id"),
                    F.timestamp_add("HOUR", F.lit(24 * 31) + F.col("_copy"), F.col("booking_date")).alias("requested_at"),
                    "user_id", "show_id",
                    F.when(bid % 33 == 0, F.lit(6)).otherwise(F.lit(1) + F.floor(bid / 7) % 5).cast("int").alias("rating"),
                    F.when(bid % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("Request "), bid.cast("string")))
                     .alias("comment")))


def cancel_requests(d: DriverData) -> DataFrame:
    """Every booking gets a cancellation: id % 7 = 0 by its owner, the others and id % 21 = 0
    by the next customer (forbidden unless that one is an admin); id % 49 = 0 names an
    unknown booking."""
    b = mapped_bookings(d)
    bid = F.col("booking_id")
    actor = F.when((bid % 7 != 0) | (bid % 21 == 0), F.col("user_id") + 1).otherwise(F.col("user_id"))
    return b.select((bid * 10 + 3).alias("request_id"),
                    F.timestamp_add("DAY", F.lit(2), F.col("booking_date")).alias("requested_at"),
                    F.when(bid % 49 == 0, -bid - 1).otherwise(bid).alias("booking_id"),
                    actor.alias("actor_id"), (actor % 100 == 0).alias("actor_is_admin"))


def payment_requests(d: DriverData) -> DataFrame:
    """Every booking gets a gateway result: id % 5 = 0 FAILED when id % 10 = 0, else
    SUCCESS; the others and id % 45 = 0 an invalid status; id % 25 = 0 gets a second SUCCESS
    later; id % 20 = 0 carries no method; id % 35 = 0 comes from another customer, id % 65 = 0
    from no known actor."""
    b = mapped_bookings(d)
    copies = F.explode(F.when(F.col("booking_id") % 25 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    bid = F.col("booking_id")
    actor = F.when(bid % 65 == 0, F.lit(None)).when(bid % 35 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    return (b.select("*", copies.alias("_copy"))
            .select((bid * 10 + 5 + F.col("_copy")).alias("request_id"),
                    F.timestamp_add("HOUR", F.col("_copy"), F.col("booking_date")).alias("requested_at"),
                    "booking_id", actor.alias("actor_id"), (actor % 100 == 0).alias("actor_is_admin"),
                    F.when(F.col("_copy") == 2, F.lit("SUCCESS"))
                     .when((bid % 5 != 0) | (bid % 45 == 0), F.lit("REFUNDED"))
                     .when(bid % 10 == 0, F.lit("FAILED")).otherwise(F.lit("SUCCESS")).alias("payment_status"),
                    F.when(bid % 20 == 0, F.lit(None).cast("string")).otherwise(F.lit("Credit Card"))
                     .alias("payment_method")))


def registration_requests(d: DriverData) -> DataFrame:
    """Each customer registers once: customers 2k and 2k+1 use the same address in
    different case (the later is DUPLICATE); c % 50 = 0 reuses an existing user's
    address; c % 97 = 0 sends no name, c % 89 = 0 a password of five letters (INVALID)."""
    c = F.col("c_custkey")
    email = (F.when(c % 50 == 0, F.concat(F.lit("U"), c.cast("string"), F.lit("@example.test")))
             .otherwise(F.concat(F.when(c % 2 == 0, F.lit("New")).otherwise(F.lit("new")),
                                 F.floor(c / 2).cast("string"), F.lit("@Example.test"))))
    return d["customer"].select(
        c.alias("request_id"),
        F.timestamp_add("MINUTE", c, F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")).alias("requested_at"),
        F.when(c % 97 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("full_name"),
        email.alias("email"), F.when(c % 89 == 0, F.lit(5)).otherwise(F.lit(6) + c % 7).cast("int").alias("password_length"))


def show_patches(d: DriverData) -> DataFrame:
    """Every show gets a patch.  id % 10 = 0: title when id % 20 = 0, base_price when
    id % 30 = 0, description set to NULL when id % 40 = 0, nothing when id % 50 = 0
    (NO_FIELDS), else show_time; id % 70 = 0 patches an unknown show (silently fine).
    By id % 10 else: 1 a price that is no number, 2 an unknown venue, 3 a NULL title,
    4 a negative price with a good title, 5 another venue, and no known field."""
    k = F.col("p_partkey")

    def entry(when, field, value):
        return F.when(when, F.struct(F.lit(field).alias("key"), value.cast("string").alias("value")))

    ten, text = (k % 10 == 0) & (k % 50 != 0), F.lit(None).cast("string")
    price = F.col("p_retailprice")
    entries = F.array_compact(F.array(
        entry(ten & (k % 20 == 0), "title", F.upper("p_name")),
        entry(ten & (k % 30 == 0), "base_price", (price + 1).cast("decimal(10,2)")),
        entry(ten & (k % 40 == 0), "description", text),
        entry(ten & (k % 20 != 0) & (k % 30 != 0) & (k % 40 != 0), "show_time", F.lit("20:30:00")),
        entry(k % 10 == 1, "base_price", F.lit("abc")), entry(k % 10 == 2, "venue_id", F.lit(999999)),
        entry(k % 10 == 3, "title", text), entry(k % 10 == 4, "title", F.upper("p_name")),
        entry(k % 10 == 4, "base_price", F.lit("-1.00")), entry(k % 10 == 5, "venue_id", k % 25),
        entry(k % 10 > 5, "colour", F.lit("red"))))
    return d["part"].select((k * 10 + 7).alias("request_id"),
                            F.timestamp_add("DAY", k % 30, F.lit("2001-02-01 00:00:00").cast("timestamp_ntz")).alias("requested_at"),
                            F.when(k % 70 == 0, -k - 1).otherwise(k).alias("show_id"),
                            F.map_from_entries(entries).alias("patch"))


def new_show_requests(d: DriverData) -> DataFrame:
    """Every part proposes a new show (a re-run); key % 300 = 0 has a negative price
    (INVALID), key % 7 = 0 an unknown venue (INVALID_REFERENCE)."""
    k = F.col("p_partkey")
    return d["part"].select(
        (k * 10 + 9).alias("request_id"),
        F.timestamp_add("MINUTE", k, F.lit("2001-03-01 00:00:00").cast("timestamp_ntz")).alias("requested_at"),
        F.concat(F.col("p_name"), F.lit(" (encore)")).alias("title"), F.lit(None).cast("string").alias("description"),
        F.date_add(F.lit("2002-01-01").cast("date"), (k % 365).cast("int")).alias("show_date"),
        F.lit("19:00:00").alias("show_time"), F.when(k % 7 == 0, F.lit(999999)).otherwise(F.col("p_size") % 25).cast("long").alias("venue_id"),
        (F.lit(1) + k % 3).cast("long").alias("category_id"),
        F.when(k % 300 == 0, F.lit(Decimal("-1.00"))).otherwise(F.col("p_retailprice").cast("decimal(10,2)"))
         .cast("decimal(10,2)").alias("base_price"))


def food_requests(d: DriverData) -> DataFrame:
    """Every supplier proposes a menu item; key % 30 = 0 has no price
    (INVALID); is_veg is omitted when key % 20 = 0 (defaults to 1)."""
    k = F.col("s_suppkey")
    return d["supplier"].select(
        (k * 10 + 1).alias("request_id"),
        F.timestamp_add("MINUTE", k, F.lit("2001-04-01 00:00:00").cast("timestamp_ntz")).alias("requested_at"),
        F.concat(F.lit("Snack "), k.cast("string")).alias("food_name"),
        F.when(k % 30 == 0, F.lit(None)).otherwise((F.lit(5) + k % 7) * 10).cast("decimal(8,2)").alias("price"),
        F.when(k % 20 == 0, F.lit(None)).otherwise((k % 40 != 0).cast("int")).cast("int").alias("is_veg"))


def access_requests(d: DriverData) -> DataFrame:
    """Every booking is read by its owner and by the next customer (P9 visibility)."""
    b = mapped_bookings(d).select("booking_id", "user_id")
    other = F.col("user_id") + 1
    return (b.select("booking_id", F.col("user_id").alias("actor_id"))
            .unionByName(b.select("booking_id", other.alias("actor_id")))
            .withColumn("actor_is_admin", F.col("actor_id") % 100 == 0))


def review_update_requests(reviews: DataFrame) -> DataFrame:
    """Every review gets an edit (rating moved by one, a new comment): id % 4 = 0 by its
    author, but for id % 8 = 0 and the others, which come from another customer, and
    id % 4 = 1, which names no actor (FORBIDDEN); id % 12 = 0 with rating 0 (INVALID);
    id % 20 = 0 names an unknown review (NOT_FOUND)."""
    rid = F.col("review_id")
    return reviews.select(
        (rid * 10 + 2).alias("request_id"), F.timestamp_add("DAY", F.lit(1), F.col("reviewed_at")).alias("requested_at"),
        F.when(rid % 20 == 0, -rid - 1).otherwise(rid).alias("review_id"),
        F.when(rid % 4 == 1, F.lit(None)).when(rid % 8 == 4, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("actor_id"),
        F.when(rid % 12 == 0, F.lit(0)).otherwise(F.col("rating") % 5 + 1).cast("int").alias("rating"),
        F.concat(F.lit("Edited "), rid.cast("string")).alias("comment"))


def review_delete_requests(reviews: DataFrame) -> DataFrame:
    """Every review gets a deletion: id % 5 = 0 by its author, but for id % 10 = 0 and the
    others, which come from the next customer (allowed only if that one is an admin), and
    id % 5 = 1, which names no actor; id % 35 = 0 is sent twice."""
    rid = F.col("review_id")
    actor = F.when(rid % 5 == 1, F.lit(None)).when(rid % 10 == 5, F.col("user_id")).otherwise(F.col("user_id") + 1)
    copies = F.explode(F.when(rid % 35 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return reviews.select("*", copies.alias("_copy")).select(
        (rid * 10 + 3 + F.col("_copy")).alias("request_id"),
        F.timestamp_add("DAY", F.lit(2) + F.col("_copy"), F.col("reviewed_at")).alias("requested_at"),
        "review_id", actor.alias("actor_id"), (actor % 100 == 0).alias("actor_is_admin"))


def seat_map_requests(d: DriverData) -> DataFrame:
    """Every part asks for a new seat map: 30 rows (capped at 26) when
    key % 20 = 0, else key % 9 rows (0 = default); key % 13 seats per row (0 =
    default); key % 3 VIP rows; 2 PREMIUM rows; default prices; key % 90 = 0 asks
    for -1 rows (INVALID); key % 70 = 0 names an unknown show."""
    k = F.col("p_partkey")
    return d["part"].select(
        F.when(k % 70 == 0, -k - 1).otherwise(k).alias("show_id"),
        F.when(k % 90 == 0, F.lit(-1)).when(k % 20 == 0, F.lit(30)).otherwise(k % 9).cast("int").alias("n_rows"),
        (k % 13).cast("int").alias("seats_per_row"), (k % 3).cast("int").alias("vip_rows"),
        F.lit(2).alias("premium_rows"), F.lit(None).cast("decimal(10,2)").alias("vip_price"),
        F.lit(None).cast("decimal(10,2)").alias("premium_price"), F.lit(None).cast("decimal(10,2)").alias("regular_price"))


def show_delete_requests(d: DriverData) -> DataFrame:
    """Every part asks for a deletion: key % 25 = 0 of its show, the others of an unknown one;
    key % 100 = 0 asks for both."""
    k = F.col("p_partkey")
    p = d["part"]
    return (p.select((k * 10 + 4).alias("request_id"), F.when(k % 25 == 0, k).otherwise(-k - 1).alias("show_id"))
            .unionByName(p.filter(k % 100 == 0).select((k * 10 + 5).alias("request_id"), (-k - 1).alias("show_id"))))


def quick_book_requests(d: DriverData) -> DataFrame:
    """Every order calls the two-seat procedure: seats number 1 + key % 48
    and the next one in row (key % 7) + 1 of the booked show (the second may not
    exist), food = key % 1200 (may not exist) with quantity key % 3 (0 = no food)."""
    b = mapped_bookings(d)
    k = F.col("booking_id")
    s1 = F.col("show_id") * 1000 + (k % 7) * 100 + 1 + k % 48
    return b.select((k * 10 + 8).alias("request_id"), F.timestamp_add("HOUR", F.lit(3), F.col("booking_date")).alias("requested_at"),
                    "user_id", "show_id", s1.alias("seat_id1"), (s1 + 1).alias("seat_id2"),
                    (k % 1200).alias("food_id"), (k % 3).cast("int").alias("food_qty"))


def title_patterns(d: DriverData) -> DataFrame:
    """Every part asks for a piece of its name: pattern_id % 10 = 0 two letters in capitals, 1 with a letter as _, 2 two
    pieces with % between, 3 its whole name backwards (rarely found), else three to eight letters; % 500 = 4 nothing."""
    k, name = F.col("p_partkey"), F.col("p_name")
    start = (F.lit(1) + k % 7).cast("int")
    piece = lambda at, n: F.substr(name, at, n)
    long = (F.lit(3) + k % 6).cast("int")
    pattern = (F.when(k % 500 == 4, F.lit("")).when(k % 10 == 0, F.upper(piece(start, F.lit(2))))
               .when(k % 10 == 1, F.concat(piece(start, F.lit(2)), F.lit("_"), piece(start + 3, F.lit(2))))
               .when(k % 10 == 2, F.concat(piece(F.lit(1), F.lit(3)), F.lit("%"), piece(start + 4, F.lit(3))))
               .when(k % 10 == 3, F.reverse(name)).otherwise(piece(start, long)))
    return d["part"].select(k.alias("pattern_id"), pattern.alias("pattern"))
