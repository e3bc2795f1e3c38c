"""The small seed state (S2) used by the tests: shape and numbers of the
reference's seed, with invented names (FIXTURES.md section 2).  Test-only input;
no registered query reads it."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import SparkSession

from marquee.sources.schemas import TABLES

D = Decimal
SHOW_DATES = [dt.date(2025, 7, 15), dt.date(2025, 8, 10), dt.date(2025, 8, 25), dt.date(2025, 9, 5), dt.date(2025, 9, 20)]
BASE_PRICES = [500, 300, 750, 400, 200]
SEAT_PRICES = [(1200, 800, 500), (800, 500, 300), (1800, 1200, 750), (1000, 700, 400), (600, 400, 200)]
FOOD_PRICES = [80, 90, 60, 40, 120, 180, 90, 150, 30, 60]
BOOKINGS = [  # booking, user, show, total, seats, food (id, qty)
    (1, 1, 1, 2400, [1, 2, 3], [(1, 2), (9, 3)]),
    (2, 2, 2, 1600, [51, 52, 53, 54], [(6, 2), (5, 2)]),
    (3, 3, 3, 3600, [101, 102, 103], [(8, 1), (4, 3)]),
    (4, 4, 1, 1000, [21, 22], [(2, 1)]),
    (5, 5, 4, 2000, [151, 152, 153, 154, 155], [(10, 2)]),
]
REVIEWS = [(1, 1, 5), (2, 2, 4), (3, 3, 5), (4, 1, 4)]  # user, show, rating
AVG = {1: D("4.50"), 2: D("4.00"), 3: D("5.00")}


def seed_rows() -> dict[str, list[tuple]]:
    t0 = dt.datetime(2025, 1, 10, 9, 0)
    rows: dict[str, list[tuple]] = {}
    rows["categories"] = [(1, "Category 1", None), (2, "Category 2", None), (3, "Category 3", None)]
    rows["venues"] = [(1, "Venue 1", "City A", "State A", 5000, "1 First Street"),
                      (2, "Venue 2", "City A", "State A", 40000, "2 Second Street"),
                      (3, "Venue 3", "City B", "State B", 2000, "3 Third Street")]
    rows["users"] = [(u, f"User {u}", f"user{u}@example.test", "", u in (1, 6), t0 + dt.timedelta(days=u))
                     for u in range(1, 7)]
    rows["shows"] = [(s, f"Show {s}", None, SHOW_DATES[s - 1], "18:00:00", [1, 2, 3, 1, 2][s - 1], [1, 2, 3, 1, 2][s - 1],
                      D(BASE_PRICES[s - 1]).quantize(D("0.01")), AVG.get(s, D("0.00"))) for s in range(1, 6)]
    booked = {sid for b in BOOKINGS for sid in b[4]}
    seats = []
    for s in range(1, 6):
        for r, letter in enumerate("ABCDE"):
            for n in range(1, 11):
                sid = (s - 1) * 50 + r * 10 + n
                kind = "VIP" if r == 0 else "PREMIUM" if r == 1 else "REGULAR"
                price = SEAT_PRICES[s - 1][min(r, 2)]
                seats.append((sid, s, letter, n, kind, 0 if sid in booked else 1, D(price).quantize(D("0.01"))))
    rows["seats"] = seats
    bdate = dt.datetime(2025, 6, 1, 10, 0)
    rows["bookings"] = [(b, u, s, bdate + dt.timedelta(hours=b), D(t).quantize(D("0.01")), "CONFIRMED", 0)
                        for b, u, s, t, _, _ in BOOKINGS]
    rows["booking_seats"] = [(b * 1000 + sid, b, sid) for b, _, _, _, sids, _ in BOOKINGS for sid in sids]
    rows["food_items"] = [(f, f"Food {f}", D(p).quantize(D("0.01")), 0 if f == 6 else 1)
                          for f, p in enumerate(FOOD_PRICES, start=1)]
    rows["booking_food"] = [(b * 100 + i, b, f, q) for b, _, _, _, _, food in BOOKINGS for i, (f, q) in enumerate(food, 1)]
    rows["payments"] = [(b, b, D(t).quantize(D("0.01")), "UPI", "SUCCESS", bdate + dt.timedelta(hours=b, minutes=5))
                        for b, _, _, t, _, _ in BOOKINGS]
    rows["reviews"] = [(i, u, s, r, None, dt.datetime(2025, 9, 1, 12, 0) + dt.timedelta(hours=i))
                       for i, (u, s, r) in enumerate(REVIEWS, start=1)]
    return rows


def seed_state(spark: SparkSession) -> dict:
    return {t: spark.createDataFrame(r, TABLES[t]) for t, r in seed_rows().items()}
