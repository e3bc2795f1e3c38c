"""The reference's stored functions as Spark SQL functions of a session.

``create_functions(st)`` registers the state tables as temporary views and three
functions whose bodies are scalar subqueries over them:

    fn_total_booking_cost(booking_id)  seats plus food of a booking, 0.00 for an unknown one
    fn_is_seat_available(seat_id)      1 or 0, 0 for an unknown seat
    fn_get_event_rating(show_id)       average rating to two decimals, 0.00 without reviews

They are expanded where they are called: Spark turns the subqueries into aggregates by key
and outer joins, so a call over a whole table is a join and not a look-up per row.
"""

from __future__ import annotations

from marquee.operators.listings import create_views

VIEWS = ("bookings", "booking_seats", "booking_food", "food_items", "seats", "reviews", "shows")

# Names and types are fixed values: callers know the routines by them.
FUNCTIONS = {
    "fn_total_booking_cost(p_booking_id BIGINT) RETURNS DECIMAL(18,2)": """
        CAST(coalesce((SELECT sum(s.price) FROM booking_seats bs JOIN seats s ON s.seat_id = bs.seat_id WHERE bs.booking_id = p_booking_id), 0)
           + coalesce((SELECT sum(f.price * bf.quantity) FROM booking_food bf JOIN food_items f ON f.food_id = bf.food_id WHERE bf.booking_id = p_booking_id), 0)
             AS DECIMAL(18,2))""",
    "fn_is_seat_available(p_seat_id BIGINT) RETURNS INT": """
        coalesce((SELECT max(s.is_available) FROM seats s WHERE s.seat_id = p_seat_id), 0)""",
    "fn_get_event_rating(p_show_id BIGINT) RETURNS DECIMAL(3,2)": """
        coalesce((SELECT CAST(CAST(floor((200 * sum(r.rating) + count(*)) / (2 * count(*))) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(3,2))
                  FROM reviews r WHERE r.show_id = p_show_id HAVING count(*) > 0), CAST(0 AS DECIMAL(3,2)))""",
}


def create_functions(st: dict, views: bool = True) -> None:
    """Register the views of ``st`` (and the three named views) and the functions in the session of its tables."""
    spark = st["bookings"].sparkSession
    # lines are far fewer than seats: each task hashes its lines and passes the seats by them, so the seats are never
    # sorted (the hint on the seats yields to the lines' hint and takes the place of a merge hint they may carry)
    hints = {"booking_seats": "shuffle_hash", "seats": "shuffle_replicate_nl"}
    for name in VIEWS:
        (st[name].hint(hints[name]) if name in hints else st[name]).createOrReplaceTempView(name)
    if views:
        create_views(st)
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
