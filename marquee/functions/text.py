"""Text helpers as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEAT_LABEL_SEPARATOR = ", "  # fixed value: the reference's GROUP_CONCAT separator


def seat_label(row_letter: Column, seat_number: Column) -> Column:
    """CONCAT(row_letter, seat_number), e.g. ``A1``."""
    return F.concat(row_letter, seat_number.cast("string"))


def seat_labels_agg(row_letter: str = "row_letter", seat_number: str = "seat_number") -> Column:
    """GROUP_CONCAT of labels in (row, number) order; no length truncation."""
    return F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(row_letter).alias("r"), F.col(seat_number).alias("n")))),
        lambda s: seat_label(s["r"], s["n"])), SEAT_LABEL_SEPARATOR)


def parse_seat_labels(df: DataFrame, col: str = "seat_labels") -> DataFrame:
    """inverse of the label list: one row per label with (position, row_letter, seat_number).
    A label is its first character (row) and the rest (number)."""
    return (df.select("*", F.posexplode(F.split(F.col(col), SEAT_LABEL_SEPARATOR)).alias("pos", "_lbl"))
            .withColumn("row_letter", F.substring("_lbl", 1, 1))
            .withColumn("seat_number", F.expr("try_cast(substring(_lbl, 2) AS INT)"))
            .drop("_lbl"))


def format_inr(amount: Column) -> Column:
    """F1: rupee text with Indian digit grouping, e.g. 1234567.5 -> '₹12,34,567.50'.

    The last three integer digits form one group, the digits before them groups of
    two.  Built from regexp_replace on the integer part; negatives get a leading '-'."""
    a = amount.cast("decimal(38,2)")
    txt = F.abs(a).cast("string")
    int_part = F.substring_index(txt, ".", 1)
    frac = F.substring_index(txt, ".", -1)
    n = F.length(int_part)
    lead = F.when(n > 3, int_part.substr(F.lit(1), n - 3)).otherwise(F.lit(""))
    tail = F.when(n > 3, int_part.substr(n - 2, F.lit(3))).otherwise(int_part)
    grouped_lead = F.regexp_replace(lead, r"(\d)(?=(\d\d)+$)", "$1,")
    body = F.when(lead == "", tail).otherwise(F.concat(grouped_lead, F.lit(","), tail))
    sign = F.when(a < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(a.isNull(), F.lit(None)).otherwise(F.concat(sign, F.lit("₹"), body, F.lit("."), frac))


def format_long_date(d: Column) -> Column:
    """weekday, day, month, year, e.g. 'Tuesday, 15 July 2025' (en-IN order)."""
    return F.date_format(d, "EEEE, d MMMM yyyy")
