"""Integrity rules of the reference's schema, re-aimed as audits (Q1-Q9).

Spark does not enforce keys, so each rule is a query returning violation rows
``(rule, table_name, row_key, detail)``.  Unique rules share one exchange of key hashes,
foreign keys one exchange of key values, and only suspect keys are looked up exactly;
CHECK, NOT NULL and domain rules of a table are one filter for rows that break any, whose
broken rules are exploded: one scan per table and no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.analytics import avg_rating
from marquee.operators.documents import booking_cost
from marquee.plans.lineage import materialize
from marquee.sources.schemas import BOOKING_STATUSES, PAYMENT_STATUSES, SEAT_TYPES, TABLES

# Fixed rule lists of the reference's DDL (primary keys, UNIQUE, FOREIGN KEY).
PRIMARY_KEYS = {
    "categories": ["category_id"], "venues": ["venue_id"], "users": ["user_id"], "shows": ["show_id"],
    "seats": ["seat_id"], "bookings": ["booking_id"], "booking_seats": ["bs_id"], "food_items": ["food_id"],
    "booking_food": ["bf_id"], "payments": ["payment_id"], "reviews": ["review_id"],
}
UNIQUE_KEYS = [
    ("categories", ["category_name"]), ("users", ["email"]), ("seats", ["show_id", "row_letter", "seat_number"]),
    ("booking_seats", ["booking_id", "seat_id"]), ("payments", ["booking_id"]), ("reviews", ["user_id", "show_id"]),
]
FOREIGN_KEYS = [
    ("shows", "venue_id", "venues", "venue_id"), ("shows", "category_id", "categories", "category_id"),
    ("seats", "show_id", "shows", "show_id"), ("bookings", "user_id", "users", "user_id"),
    ("bookings", "show_id", "shows", "show_id"), ("booking_seats", "booking_id", "bookings", "booking_id"),
    ("booking_seats", "seat_id", "seats", "seat_id"), ("booking_food", "booking_id", "bookings", "booking_id"),
    ("booking_food", "food_id", "food_items", "food_id"), ("payments", "booking_id", "bookings", "booking_id"),
    ("reviews", "user_id", "users", "user_id"), ("reviews", "show_id", "shows", "show_id"),
]
SENT_IDS = 2_000_000  # orphaned ids or hashes of suspects (a long each) that may be sent to every executor
CASE_INSENSITIVE = {("users", "email"), ("categories", "category_name")}


def _key_text(cols: list[str]) -> F.Column:
    return F.concat_ws(",", *[F.col(c).cast("string") for c in cols])


def _violations(df: DataFrame, rule: str, table: str, key: F.Column, detail: F.Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"),
                     key.cast("string").alias("row_key"), detail.cast("string").alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _key_columns(table: str, cols: list[str]) -> list[F.Column]:
    return [(F.lower(c) if (table, c) in CASE_INSENSITIVE else F.col(c)).alias(c) for c in cols]


def _key_block(df: DataFrame, table: str, cols: list[str]) -> tuple[F.Column, F.Column]:
    """A key's hash and bit: equal keys have both in common.  The last column, if it is a number, gives the bit (its last
    six bits) and the hash takes the rest; other keys are hashed whole."""
    keys = [F.lower(c) if (table, c) in CASE_INSENSITIVE else F.col(c) for c in cols]
    if df.schema[cols[-1]].dataType.typeName() not in ("long", "integer"):
        return F.xxhash64(*keys), F.lit(1).cast("long")
    last = F.col(cols[-1]).cast("long")
    return F.xxhash64(*keys[:-1], F.shiftright(last, 6)), F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce(last.bitwiseAND(63), F.lit(0)).cast("int"))


def audit_unique(st: dict) -> DataFrame:
    """Q1: 11 primary keys and 6 UNIQUE rules; text keys compare without case.

    All rules share one exchange: a row gives, per rule, the hash of its key but for the last six bits of its last number,
    and these as one bit of 64, so neighbouring keys are one row a task.  Where there are more rows than bits, a key may come
    twice (suspects): only rows of such hashes go to the exact count of their keys, so equal hashes of different keys
    are no violation.  Suspects that are few are sent to where the rows are."""
    rules = [(t, cols, "primary_key") for t, cols in PRIMARY_KEYS.items()] + [(t, c, "unique") for t, c in UNIQUE_KEYS]
    hashes = []
    for table in dict.fromkeys(t for t, _, _ in rules):
        own = []
        for k, (t, cols, _) in enumerate(rules):
            if t == table:
                block, bit = _key_block(st[t], t, cols)
                own.append(F.struct(F.lit(k).alias("rule"), block.alias("hash"), bit.alias("bits")))
        hashes.append(st[table].select(F.explode(F.array(*own)).alias("r")).select("r.*"))
    counted = _union(hashes).groupBy("rule", "hash").agg(F.count(F.lit(1)).alias("_n"), F.bit_or("bits").alias("_bits"))
    suspects = materialize(counted.filter("_n > bit_count(_bits)").select("rule", "hash"), "audit-suspects")
    broken = {r.rule: r.n for r in suspects.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row per rule
    parts = []
    for k, (table, cols, kind) in enumerate(rules):
        if k not in broken:
            continue
        keyed = st[table].withColumn("hash", _key_block(st[table], table, cols)[0]).select(*_key_columns(table, cols), "hash")
        few = suspects.filter(F.col("rule") == k).select("hash")
        # more than may be sent: hashed by task, and the rows pass by them unsorted
        few = F.broadcast(few) if broken[k] <= SENT_IDS else few.hint("shuffle_hash")
        mine = keyed.hint("shuffle_replicate_nl").join(few, "hash", "left_semi")
        dup = mine.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        parts.append(_violations(dup, f"{kind}({','.join(cols)})", table, _key_text(cols),
                                 F.concat(F.lit("rows="), F.col("_n").cast("string"))))
    nothing = suspects.sparkSession.createDataFrame([], "rule string, table_name string, row_key string, detail string")
    return _union(parts) if parts else nothing


def _id_blocks(rows: DataFrame, side: str) -> DataFrame:
    """(parent, value) -> (parent, block, named, held): the value is a bit of its block of 64 ids, on one side."""
    bit = F.expr("shiftleft(1L, cast(value & 63 as int))")
    return rows.filter("value is not null").select("parent", F.shiftright("value", 6).alias("block"), *[
        (bit if name == side else F.lit(0).cast("long")).alias(name) for name in ("named", "held")])


def audit_fk(st: dict) -> DataFrame:
    """Q2: 12 foreign keys; the row key is the child's primary key.

    All keys share one exchange: children's and parents' key values (ids) meet as bits of blocks of 64 ids, which the map
    side reduces to a row per block and task; values that no parent row has are orphans, and only rows with such a value are looked up in the child tables again, each table once for all its keys.  Orphans that are
    few (as a rule) are sent to where the children are, so no child row is moved for them."""
    parents = sorted({p for _, _, p, _ in FOREIGN_KEYS})
    values = []
    for child in dict.fromkeys(c for c, _, _, _ in FOREIGN_KEYS):
        own = [(parents.index(p), F.col(col).cast("long")) for c, col, p, _ in FOREIGN_KEYS if c == child]
        if len(own) == 1:
            rows = st[child].select(F.lit(own[0][0]).alias("parent"), own[0][1].alias("value"))
        else:
            rows = st[child].select(F.explode(F.array(*[F.struct(F.lit(k).alias("parent"), v.alias("value")) for k, v in own])).alias("r")).select("r.*")
        values.append(_id_blocks(rows, "named"))
    for k, p in enumerate(parents):
        key = next(pcol for _, _, q, pcol in FOREIGN_KEYS if q == p)
        values.append(_id_blocks(st[p].select(F.lit(k).alias("parent"), F.col(key).cast("long").alias("value")), "held"))
    blocks = _union(values).groupBy("parent", "block").agg(F.bit_or("named").alias("named"), F.bit_or("held").alias("held"))
    lost = blocks.withColumn("lost", F.expr("named & ~held")).filter("lost <> 0").select("parent", "block", "lost", F.explode(F.expr("sequence(0, 63)")).alias("bit"))
    orphaned = materialize(lost.filter("lost & shiftleft(1L, bit) <> 0").select("parent", F.expr("shiftleft(block, 6) | bit").alias("value")), "audit-orphans")
    lost = {r.parent: r.n for r in orphaned.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row per parent table
    parts = []
    for child in dict.fromkeys(c for c, _, _, _ in FOREIGN_KEYS):
        rows, found = st[child], []
        for col, parent in ((col, p) for c, col, p, _ in FOREIGN_KEYS if c == child and parents.index(p) in lost):
            k, mark = parents.index(parent), f"_lost_{col}"
            ids = orphaned.filter(F.col("parent") == k).select(F.col("value").alias(mark))
            # more than may be sent: hashed by task, and the children pass by them unsorted
            ids = F.broadcast(ids) if lost[k] <= SENT_IDS else ids.hint("shuffle_hash")
            rows = rows.hint("shuffle_replicate_nl").join(ids, F.col(col).cast("long") == F.col(mark), "left")
            found.append(F.when(F.col(mark).isNotNull(), F.struct(F.lit(f"fk({col}->{parent})").alias("rule"),
                                                                   F.concat(F.lit(f"{col}="), F.col(col).cast("string")).alias("detail"))))
        if found:
            some = reduce(lambda a, b: a | b, [f.isNotNull() for f in found])
            parts.append(rows.filter(some).select(_key_text(PRIMARY_KEYS[child]).alias("row_key"), F.explode(F.array_compact(F.array(*found))).alias("b")).select(
                F.col("b.rule").alias("rule"), F.lit(child).alias("table_name"), "row_key", F.col("b.detail").alias("detail")))
    nothing = orphaned.sparkSession.createDataFrame([], "rule string, table_name string, row_key string, detail string")
    return _union(parts) if parts else nothing


def check_rules() -> list[tuple[str, str, F.Column, str]]:
    """(table, rule name, condition that must hold, column shown) of the 10 CHECK constraints."""
    return [
        ("venues", "capacity>0", F.col("capacity") > 0, "capacity"),
        ("shows", "base_price>=0", F.col("base_price") >= 0, "base_price"),
        ("shows", "avg_rating between 0 and 5", F.col("avg_rating").between(0, 5), "avg_rating"),
        ("seats", "price>=0", F.col("price") >= 0, "price"),
        ("bookings", "booking_status in domain", F.col("booking_status").isin(*BOOKING_STATUSES), "booking_status"),
        ("bookings", "total_amount>=0", F.col("total_amount") >= 0, "total_amount"),
        ("food_items", "price>=0", F.col("price") >= 0, "price"),
        ("booking_food", "quantity>0", F.col("quantity") > 0, "quantity"),
        ("payments", "amount>=0", F.col("amount") >= 0, "amount"),
        ("reviews", "rating between 1 and 5", F.col("rating").between(1, 5), "rating"),
    ]


DOMAINS = [("seats", "seat_type", SEAT_TYPES), ("payments", "payment_status", PAYMENT_STATUSES)]


def _row_rules(kinds: tuple[str, ...]) -> dict[str, list[tuple[str, F.Column, F.Column]]]:
    """Per table: (rule, condition that breaks it, detail)."""
    rules: dict[str, list] = {t: [] for t in TABLES}
    if "check" in kinds:
        for table, name, cond, col in check_rules():
            rules[table].append((f"check({name})", ~F.coalesce(cond, F.lit(True)),
                                 F.concat(F.lit(f"{col}="), F.coalesce(F.col(col).cast("string"), F.lit("NULL")))))
    if "not_null" in kinds:
        for table, schema in TABLES.items():
            rules[table] += [(f"not_null({f.name})", F.col(f.name).isNull(), F.lit(f"{f.name} is NULL")) for f in schema.fields if not f.nullable]
    if "domain" in kinds:
        for table, col, values in DOMAINS:
            rules[table].append((f"domain({col})", ~F.col(col).isin(*values), F.concat(F.lit(f"{col}="), F.col(col))))
    return {t: r for t, r in rules.items() if r}


def audit_rows(st: dict, kinds: tuple[str, ...] = ("check", "not_null", "domain")) -> DataFrame:
    """Q3, Q4 and Q5 in one pass over each table."""
    parts = []
    for table, rules in _row_rules(kinds).items():
        broken = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))
                                           for rule, bad, detail in rules]))
        some = reduce(lambda a, b: a | b, [F.coalesce(bad, F.lit(False)) for _, bad, _ in rules])  # clean rows end here
        parts.append(st[table].filter(some).select(_key_text(PRIMARY_KEYS[table]).alias("row_key"), F.explode(broken).alias("b")).select(
            F.col("b.rule").alias("rule"), F.lit(table).alias("table_name"), "row_key", F.col("b.detail").alias("detail")))
    return _union(parts)


def audit_check(st: dict) -> DataFrame:
    """Q3: rows where a CHECK condition is false (NULL passes, as in SQL)."""
    return audit_rows(st, ("check",))


def audit_not_null(st: dict) -> DataFrame:
    """Q4: NULL in a NOT NULL column of the declared schemas."""
    return audit_rows(st, ("not_null",))


def audit_domain(st: dict) -> DataFrame:
    """Q5: ENUM domains of seat_type and payment_status."""
    return audit_rows(st, ("domain",))


def double_booked_seats(st: dict) -> DataFrame:
    """Q6: seats held by more than one CONFIRMED booking (the row lock's intent).
    One row per (seat, booking) of such a seat, with the seat's booking count: the
    count is a partial aggregate over distinct (seat, booking) pairs, and nothing is
    collected per seat, so an oversold seat costs rows, not one large group."""
    conf = st["bookings"].filter(F.col("booking_status") == "CONFIRMED").select("booking_id")
    pairs = st["booking_seats"].join(conf, "booking_id", "left_semi").select("seat_id", "booking_id").distinct()
    per_seat = pairs.groupBy("seat_id").agg(F.count(F.lit(1)).alias("n_bookings")).filter(F.col("n_bookings") > 1)
    return (pairs.join(per_seat, "seat_id")
            .join(st["seats"].select("seat_id", "show_id"), "seat_id", "left")
            .select("seat_id", "show_id", "booking_id", "n_bookings"))


def rating_drift(st: dict) -> DataFrame:
    """Q7: shows whose stored avg_rating differs from the live average."""
    live = avg_rating(st).select("show_id", F.col("avg_rating").alias("live_rating"))
    return (st["shows"].select("show_id", F.col("avg_rating").alias("stored_rating")).join(live, "show_id")
            .filter(F.col("stored_rating") != F.col("live_rating")))


def cost_drift(st: dict) -> DataFrame:
    """Q8: bookings whose stored total differs from seats + food."""
    cost = booking_cost(st).select("booking_id", "total_cost")
    return (st["bookings"].select("booking_id", F.col("total_amount").cast("decimal(18,2)").alias("stored_total"))
            .join(cost, "booking_id").filter(F.col("stored_total") != F.col("total_cost")))


def availability_drift(st: dict) -> DataFrame:
    """Q9: seats whose is_available differs from "no line of a non-CANCELLED booking"."""
    live = (st["booking_seats"].join(st["bookings"].filter(F.col("booking_status") != "CANCELLED").select("booking_id"),
                                     "booking_id", "left_semi").select("seat_id").distinct().withColumn("_held", F.lit(True)))
    return (st["seats"].join(live, "seat_id", "left")
            .select("seat_id", "show_id", F.col("is_available").alias("stored_available"),
                    F.when(F.col("_held"), 0).otherwise(1).alias("expected_available"))
            .filter(F.col("stored_available") != F.col("expected_available")))
