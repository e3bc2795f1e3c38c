"""Revenue, rating and customer analytics.

Pattern throughout: aggregate the large side down to one row per key *before*
joining it to the entity table (partial aggregation runs map-side, so a hot key
costs one partial row per task, not a hot shuffle partition), then left join so
entities without activity keep a zero row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.numeric import half_up_ratio, money, rating_round

def ZERO():
    return F.lit(Decimal("0.00"))


def confirmed(st: dict) -> DataFrame:
    return st["bookings"].filter(F.col("booking_status") == "CONFIRMED")


def avg_rating(st: dict, show_ids: DataFrame | None = None) -> DataFrame:
    """fn_get_event_rating (A8): per show ROUND(AVG(rating),2) and review count; none => 0."""
    agg = (st["reviews"].groupBy("show_id")
           .agg(F.sum("rating").alias("_s"), F.count(F.lit(1)).alias("review_count")))
    shows = st["shows"].select("show_id")
    if show_ids is not None:
        shows = shows.join(show_ids.select("show_id").distinct(), "show_id", "left_semi")
    return (shows.join(agg, "show_id", "left")
            .select("show_id", rating_round(F.col("_s"), F.col("review_count")).alias("avg_rating"),
                    F.coalesce("review_count", F.lit(0)).cast("long").alias("review_count")))


def view_event_revenue(st: dict) -> DataFrame:
    """vw_event_revenue (A4/J4): the status test sits in the join condition, so a
    show without confirmed bookings keeps a (0, 0.00) row."""
    per_show = (confirmed(st).groupBy("show_id")
                .agg(F.count("booking_id").alias("total_bookings"), F.sum("total_amount").alias("_rev")))
    return (st["shows"].select("show_id", "title", "show_date", "avg_rating")
            .join(per_show, "show_id", "left")
            .select("show_id", "title", "show_date",
                    F.coalesce("total_bookings", F.lit(0)).cast("long").alias("total_bookings"),
                    money(F.coalesce("_rev", ZERO())).alias("total_revenue"),
                    "avg_rating"))


def revenue_by_event(st: dict) -> DataFrame:
    """A5: confirmed bookings only, revenue desc; shows without sales are absent."""
    per_show = (confirmed(st).groupBy("show_id")
                .agg(F.sum("total_amount").alias("_rev"), F.count("booking_id").alias("bookings")))
    return (per_show.join(st["shows"].select("show_id", "title"), "show_id")
            .select("show_id", "title", money(F.col("_rev")).alias("revenue"),
                    F.col("bookings").cast("long").alias("bookings"))
            .orderBy(F.desc("revenue"), "show_id"))


def user_spend(st: dict) -> DataFrame:
    """Per user confirmed count and total spent (0 kept), newest user first."""
    per_user = (confirmed(st).groupBy("user_id")
                .agg(F.count("booking_id").alias("total_bookings"), F.sum("total_amount").alias("_spent")))
    return (st["users"].select("user_id", "full_name", "email", "is_admin", "created_at")
            .join(per_user, "user_id", "left")
            .select("user_id", "full_name", "email", "is_admin", "created_at",
                    F.coalesce("total_bookings", F.lit(0)).cast("long").alias("total_bookings"),
                    money(F.coalesce("_spent", ZERO())).alias("total_spent"))
            .orderBy(F.desc("created_at"), "user_id"))


def dashboard_overview(st: dict) -> DataFrame:
    """Users, shows, confirmed bookings and successful payment revenue in one row.
    The four inputs are projected to one narrow shape and unioned, so the whole
    dashboard is a single global aggregate (map-side partials, one tiny final
    task) with no join between the four counts."""
    amount = F.lit(None).cast("decimal(10,2)")
    parts = [st["users"].select(F.lit("u").alias("_k"), amount.alias("_a")),
             st["shows"].select(F.lit("s").alias("_k"), amount.alias("_a")),
             confirmed(st).select(F.lit("b").alias("_k"), amount.alias("_a")),
             st["payments"].filter(F.col("payment_status") == "SUCCESS")
             .select(F.lit("p").alias("_k"), F.col("amount").cast("decimal(10,2)").alias("_a"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return u.agg(F.count_if(F.col("_k") == "u").alias("total_users"),
                 F.count_if(F.col("_k") == "s").alias("total_events"),
                 F.count_if(F.col("_k") == "b").alias("total_bookings"),
                 money(F.coalesce(F.sum(F.when(F.col("_k") == "p", F.col("_a"))), ZERO())).alias("total_revenue"))


def top_rated_events(st: dict, n: int = 5) -> DataFrame:
    """Top n shows by stored avg_rating, review count attached; ties by show id.
    The limit is the feature (a top-k report): TakeOrderedAndProject keeps n rows per task."""
    counts = st["reviews"].groupBy("show_id").agg(F.count("review_id").alias("_n"))
    return (st["shows"].select("show_id", "title", "avg_rating")
            .join(counts, "show_id", "left")
            .select("show_id", "title", "avg_rating", F.coalesce("_n", F.lit(0)).cast("long").alias("review_count"))
            .orderBy(F.desc("avg_rating"), "show_id").limit(n))


def recent_bookings(st: dict, n: int = 10) -> DataFrame:
    """The n newest bookings with customer and title (top-k, tie by booking id desc)."""
    top = st["bookings"].orderBy(F.desc("booking_date"), F.desc("booking_id")).limit(n)
    return (top.join(st["users"].select("user_id", "full_name"), "user_id")
            .join(st["shows"].select("show_id", "title"), "show_id")
            .select("booking_id", "full_name", "title", "total_amount", "booking_status", "booking_date")
            .orderBy(F.desc("booking_date"), F.desc("booking_id")))


def rating_distribution(st: dict, show_ids: DataFrame | None = None) -> DataFrame:
    """Per show and star 5..1 the count and its percentage (1 decimal, exact half-up)
    of the show's reviews; absent stars give {count 0, percentage 0.0}.  Stars come
    from a bounded 5-row literal; counts are one group per (show, star)."""
    shows = st["shows"].select("show_id")
    if show_ids is not None:
        shows = shows.join(show_ids.select("show_id").distinct(), "show_id", "left_semi")
    per_star = st["reviews"].groupBy("show_id", "rating").agg(F.count(F.lit(1)).alias("_c"))
    totals = per_star.groupBy("show_id").agg(F.sum("_c").alias("_t"))
    grid = shows.select("show_id", F.explode(F.sequence(F.lit(5), F.lit(1), F.lit(-1))).alias("rating"))
    return (grid.join(per_star, ["show_id", "rating"], "left").join(totals, "show_id", "left")
            .select("show_id", F.col("rating").cast("int").alias("rating"),
                    F.coalesce("_c", F.lit(0)).cast("long").alias("count"),
                    F.coalesce(half_up_ratio(F.coalesce("_c", F.lit(0)), F.col("_t"), 1, times=100, precision=4),
                               F.lit(Decimal("0.0"))).cast("decimal(4,1)").alias("percentage"))
            .orderBy("show_id", F.desc("rating")))


def rating_summary(st: dict, show_ids: DataFrame | None = None) -> DataFrame:
    """The distribution endpoint's nested document: avg, total and {star: {count, percentage}}."""
    dist = rating_distribution(st, show_ids)
    nested = dist.groupBy("show_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "rating", F.struct("count", "percentage")))).alias("distribution"))
    return avg_rating(st, show_ids).withColumnRenamed("review_count", "total_reviews").join(nested, "show_id")
