"""Independent DuckDB SQL for every registered query.

Each statement starts from the raw driver views (``customer``, ``orders``,
``lineitem`` ...) and rebuilds the booking-shaped tables in a ``WITH`` prefix,
so the oracle shares no code with the Spark side.  Rounding follows the
library's rule: exact half-up on integers (DuckDB's ``avg`` on decimals is a
double), every output column cast to the same type the Spark query emits.
"""

from __future__ import annotations

import re

# --------------------------------------------------------------------------
# booking-shaped tables over the driver tables (FIXTURES.md section 3)
# --------------------------------------------------------------------------
_MAPPING = r"""
np_ AS (SELECT count(*) AS np FROM part),
users AS (
  SELECT CAST(c_custkey AS BIGINT) AS user_id, c_name AS full_name,
         'u' || c_custkey || '@example.test' AS email, '' AS password_hash,
         (c_custkey % 100 = 0) AS is_admin,
         CAST(DATE '1994-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP) AS created_at
  FROM customer),
venues AS (
  SELECT CAST(n_nationkey AS BIGINT) AS venue_id, n_name AS venue_name, n_name AS city,
         r_name AS state, CAST(1000 + 100 * n_nationkey AS INTEGER) AS capacity, n_name AS address
  FROM nation JOIN region ON n_regionkey = r_regionkey),
categories AS (
  SELECT CAST(row_number() OVER (ORDER BY p_type) AS BIGINT) AS category_id,
         p_type AS category_name, CAST(NULL AS VARCHAR) AS description
  FROM (SELECT DISTINCT p_type FROM part)),
bookings AS (
  SELECT o_orderkey AS booking_id, o_custkey AS user_id,
         o_orderkey % np - o_orderkey % 2 AS show_id,
         o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS booking_date,
         CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
         CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'PENDING' ELSE 'CANCELLED' END
           AS booking_status,
         CAST(o_orderkey % 4 = 0 AS INTEGER) AS reminder_sent,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'UPI' WHEN '2' THEN 'Debit Card'
              WHEN '3' THEN 'Net Banking' WHEN '4' THEN 'Credit Card' ELSE 'UPI' END AS method_,
         substr(o_orderpriority, 1, 1) AS prio_
  FROM orders, np_),
reviews AS (
  SELECT booking_id AS review_id, user_id, show_id,
         CAST(1 + (booking_id // 7) % 5 AS INTEGER) AS rating,
         CASE WHEN booking_id % 2 = 0 THEN NULL ELSE 'Review of booking ' || booking_id END AS comment,
         booking_date + INTERVAL 30 DAY AS reviewed_at
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, show_id ORDER BY booking_id) AS rn_
        FROM bookings WHERE booking_status = 'CONFIRMED' AND booking_id % 3 = 0)
  WHERE rn_ = 1),
shows AS (
  SELECT p_partkey AS show_id, p_name AS title, CAST(NULL AS VARCHAR) AS description,
         DATE '1995-01-01' + CAST(p_partkey % 2400 AS INTEGER) AS show_date,
         '18:00:00' AS show_time, CAST(p_size % 25 AS BIGINT) AS venue_id, c.category_id,
         CAST(p_retailprice AS DECIMAL(10,2)) AS base_price,
         CAST(coalesce(CAST((200 * r.s + r.n) // (2 * r.n) AS DECIMAL(18,0)) * 0.01, 0) AS DECIMAL(3,2))
           AS avg_rating
  FROM part JOIN categories c ON c.category_name = p_type
  LEFT JOIN (SELECT show_id, sum(rating) AS s, count(*) AS n FROM reviews GROUP BY show_id) r
         ON r.show_id = p_partkey),
line_seats_ AS (
  SELECT l.l_orderkey AS booking_id, b.show_id,
         b.show_id * 1000 + (l.l_linenumber - 1) * 100 + CAST(l.l_quantity AS BIGINT) AS seat_id
  FROM lineitem l JOIN bookings b ON b.booking_id = l.l_orderkey
  WHERE b.booking_status <> 'CANCELLED' AND l.l_quantity <= 48),
booking_seats AS (
  SELECT booking_id * 1000 + seat_id % 1000 AS bs_id, booking_id, seat_id
  FROM (SELECT DISTINCT booking_id, seat_id FROM line_seats_)),
seat_grid_ AS (
  SELECT s.show_id, CAST(r.r AS INTEGER) AS rw, CAST(n.n AS INTEGER) AS num
  FROM shows s, range(1, 8) r(r), range(1, 49) n(n)),
seats AS (
  SELECT g.show_id * 1000 + (g.rw - 1) * 100 + g.num AS seat_id, g.show_id,
         chr(CAST(64 + g.rw AS INTEGER)) AS row_letter, g.num AS seat_number,
         CASE WHEN g.rw <= 1 THEN 'VIP' WHEN g.rw <= 2 THEN 'PREMIUM' ELSE 'REGULAR' END AS seat_type,
         CASE WHEN t.seat_id IS NULL THEN 1 ELSE 0 END AS is_available,
         CAST(CASE WHEN g.rw <= 1 THEN 1200 WHEN g.rw <= 2 THEN 800 ELSE 500 END AS DECIMAL(10,2)) AS price
  FROM seat_grid_ g
  LEFT JOIN (SELECT DISTINCT bs.seat_id FROM booking_seats bs
             JOIN bookings b ON b.booking_id = bs.booking_id
             WHERE b.booking_status <> 'CANCELLED') t
         ON t.seat_id = g.show_id * 1000 + (g.rw - 1) * 100 + g.num),
food_items AS (
  SELECT s_suppkey AS food_id, s_name AS food_name,
         CAST(10 * (1 + s_suppkey % 20) AS DECIMAL(8,2)) AS price,
         CAST(s_suppkey % 4 <> 0 AS INTEGER) AS is_veg
  FROM supplier),
booking_food AS (
  SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity) AS bf_id,
         l_orderkey AS booking_id, l_suppkey AS food_id, l_linenumber AS quantity
  FROM lineitem WHERE l_returnflag = 'R'),
payments AS (
  SELECT booking_id AS payment_id, booking_id, total_amount AS amount, method_ AS payment_method,
         CASE booking_status WHEN 'CONFIRMED' THEN 'SUCCESS' WHEN 'PENDING' THEN 'PENDING'
              ELSE 'FAILED' END AS payment_status,
         CASE WHEN booking_status = 'CONFIRMED' THEN booking_date + INTERVAL 5 MINUTE END AS paid_at
  FROM bookings WHERE booking_status <> 'CANCELLED' OR booking_id % 2 = 0)
"""


def mapping_cte(extra: str = "", recursive: bool = False) -> str:
    """``WITH`` prefix defining the booking tables; ``extra`` appends more CTEs."""
    body = _MAPPING.strip()
    if extra:
        body = body + ",\n" + extra.strip()
    return ("WITH RECURSIVE " if recursive else "WITH ") + body + "\n"


def q(select: str, extra: str = "", recursive: bool = False) -> str:
    return mapping_cte(extra, recursive) + select.strip()


# extra CTEs used by several statements
_REQ_SEATS = r"""
req_seats_ AS (
  SELECT l.l_orderkey AS request_id, b.show_id,
         b.show_id * 1000 + (l.l_linenumber - 1) * 100 + CAST(l.l_quantity AS BIGINT) AS seat_id
  FROM lineitem l JOIN bookings b ON b.booking_id = l.l_orderkey)
"""
_REVIEW_REQ = r"""
review_req_ AS (
  SELECT b.booking_id * 10 + c.c AS request_id, b.user_id, b.show_id
  FROM bookings b, range(1, 3) c(c)
  WHERE c.c = 1 OR b.booking_id % 15 = 0)
"""
_ACCESS = r"""
access_ AS (
  SELECT booking_id, user_id AS actor_id, (user_id % 100 = 0) AS actor_is_admin FROM bookings
  UNION ALL
  SELECT booking_id, user_id + 1, ((user_id + 1) % 100 = 0) FROM bookings)
"""
_SEAT_LINES = r"""
seat_lines_ AS (
  SELECT bs.booking_id, s.seat_id, s.show_id, s.row_letter, s.seat_number, s.seat_type, s.price
  FROM booking_seats bs JOIN seats s ON s.seat_id = bs.seat_id)
"""
_LISTING = r"""
SELECT s.show_id, s.title, s.description, s.show_date, s.show_time, s.base_price, s.avg_rating,
       v.venue_name, v.city, v.state, v.capacity, c.category_name,
       CAST(coalesce(k.total_seats, 0) AS BIGINT) AS total_seats,
       CAST(coalesce(k.available_seats, 0) AS BIGINT) AS available_seats
FROM shows s JOIN venues v ON v.venue_id = s.venue_id JOIN categories c ON c.category_id = s.category_id
LEFT JOIN (SELECT show_id, count(seat_id) AS total_seats,
                  sum(CASE WHEN is_available = 1 THEN 1 ELSE 0 END) AS available_seats
           FROM seats GROUP BY show_id) k ON k.show_id = s.show_id
WHERE 1 = 1 {where}
ORDER BY s.show_date, s.show_id
"""
_AS_OF = "DATE '1995-03-01'"

ORACLE: dict[str, str] = {}

ORACLE["view_event_revenue"] = q("""
SELECT s.show_id, s.title, s.show_date, CAST(count(b.booking_id) AS BIGINT) AS total_bookings,
       CAST(coalesce(sum(b.total_amount), 0) AS DECIMAL(18,2)) AS total_revenue, s.avg_rating
FROM shows s LEFT JOIN bookings b ON s.show_id = b.show_id AND b.booking_status = 'CONFIRMED'
GROUP BY s.show_id, s.title, s.show_date, s.avg_rating""")

ORACLE["revenue_by_event"] = q("""
SELECT b.show_id, s.title, CAST(sum(b.total_amount) AS DECIMAL(18,2)) AS revenue,
       CAST(count(b.booking_id) AS BIGINT) AS bookings
FROM bookings b JOIN shows s ON b.show_id = s.show_id
WHERE b.booking_status = 'CONFIRMED' GROUP BY b.show_id, s.title ORDER BY revenue DESC, b.show_id""")

ORACLE["user_spend"] = q("""
SELECT u.user_id, u.full_name, u.email, u.is_admin, u.created_at,
       CAST(count(b.booking_id) AS BIGINT) AS total_bookings,
       CAST(coalesce(sum(b.total_amount), 0) AS DECIMAL(18,2)) AS total_spent
FROM users u LEFT JOIN bookings b ON u.user_id = b.user_id AND b.booking_status = 'CONFIRMED'
GROUP BY u.user_id, u.full_name, u.email, u.is_admin, u.created_at""")

ORACLE["dashboard_overview"] = q("""
SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM shows) AS total_events,
       (SELECT count(*) FROM bookings WHERE booking_status = 'CONFIRMED') AS total_bookings,
       (SELECT CAST(coalesce(sum(amount), 0) AS DECIMAL(18,2)) FROM payments WHERE payment_status = 'SUCCESS')
         AS total_revenue""")

ORACLE["top_rated_events"] = q("""
SELECT s.show_id, s.title, s.avg_rating, CAST(count(r.review_id) AS BIGINT) AS review_count
FROM shows s LEFT JOIN reviews r ON r.show_id = s.show_id
GROUP BY s.show_id, s.title, s.avg_rating ORDER BY s.avg_rating DESC, s.show_id LIMIT 5""")

ORACLE["recent_bookings"] = q("""
SELECT b.booking_id, u.full_name, s.title, b.total_amount, b.booking_status, b.booking_date
FROM bookings b JOIN users u ON u.user_id = b.user_id JOIN shows s ON s.show_id = b.show_id
ORDER BY b.booking_date DESC, b.booking_id DESC LIMIT 10""")

ORACLE["avg_rating"] = q("""
SELECT s.show_id,
       CAST(coalesce(CAST((200 * r.s + r.n) // (2 * r.n) AS DECIMAL(18,0)) * 0.01, 0) AS DECIMAL(3,2)) AS avg_rating,
       CAST(coalesce(r.n, 0) AS BIGINT) AS review_count
FROM shows s LEFT JOIN (SELECT show_id, sum(rating) AS s, count(*) AS n FROM reviews GROUP BY show_id) r
  ON r.show_id = s.show_id""")

ORACLE["rating_distribution"] = q("""
SELECT s.show_id, CAST(g.r AS INTEGER) AS rating, CAST(coalesce(c.c, 0) AS BIGINT) AS count,
       CAST(CASE WHEN t.t IS NULL THEN 0
                 ELSE CAST((2000 * coalesce(c.c, 0) + t.t) // (2 * t.t) AS DECIMAL(18,0)) * 0.1 END
            AS DECIMAL(4,1)) AS percentage
FROM shows s CROSS JOIN range(1, 6) g(r)
LEFT JOIN (SELECT show_id, rating, count(*) AS c FROM reviews GROUP BY 1, 2) c
  ON c.show_id = s.show_id AND c.rating = g.r
LEFT JOIN (SELECT show_id, count(*) AS t FROM reviews GROUP BY 1) t ON t.show_id = s.show_id""")

ORACLE["scan_catalog"] = q("""
SELECT 'category' AS kind, category_id AS item_id, category_name AS name, CAST(NULL AS VARCHAR) AS city,
       CAST(NULL AS VARCHAR) AS state, CAST(NULL AS INTEGER) AS capacity FROM categories
UNION ALL
SELECT 'venue', venue_id, venue_name, city, state, capacity FROM venues""")

ORACLE["show_listing"] = q(_LISTING.format(where=""))
ORACLE["show_listing_filtered"] = q(_LISTING.format(
    where="AND s.category_id = 2 AND lower(v.city) = lower('nation_3') "
          "AND s.show_date >= DATE '1996-01-01' AND s.show_date <= DATE '1999-12-31'"))
ORACLE["show_search"] = q(_LISTING.format(where="AND s.title ILIKE '%Ring%'"))
ORACLE["show_date_range"] = q(_LISTING.format(
    where="AND s.show_date >= DATE '1996-03-01' AND s.show_date <= DATE '1996-06-30'"))

ORACLE["point_lookup"] = q("SELECT * FROM shows WHERE show_id IN (SELECT show_id FROM bookings)")

ORACLE["seat_summary"] = q("""
SELECT show_id, seat_type, price, count(*) AS total,
       CAST(sum(CASE WHEN is_available = 1 THEN 1 ELSE 0 END) AS BIGINT) AS available
FROM seats GROUP BY show_id, seat_type, price""")

ORACLE["show_detail"] = q("""
SELECT s.show_id, s.title, s.show_date, s.base_price, v.venue_name, v.city, v.state, v.capacity, v.address,
       c.category_name, coalesce(m.txt, '') AS seat_summary
FROM shows s JOIN venues v ON v.venue_id = s.venue_id JOIN categories c ON c.category_id = s.category_id
LEFT JOIN (SELECT show_id, string_agg(seat_type || ' ' || CAST(price AS VARCHAR) || ' ' || available || '/' || total,
                                     '; ' ORDER BY seat_type, price, total, available) AS txt
           FROM (SELECT show_id, seat_type, price, count(*) AS total,
                        sum(CASE WHEN is_available = 1 THEN 1 ELSE 0 END) AS available
                 FROM seats GROUP BY show_id, seat_type, price) GROUP BY show_id) m ON m.show_id = s.show_id""")

ORACLE["view_available_seats"] = q("""
SELECT s.show_id, e.title, s.seat_type, count(*) AS available_count, min(s.price) AS min_price
FROM seats s JOIN shows e ON s.show_id = e.show_id WHERE s.is_available = 1
GROUP BY s.show_id, e.title, s.seat_type""")

ORACLE["view_booking_summary"] = q("""
SELECT b.booking_id, u.full_name AS customer_name, e.title AS event_name, v.venue_name, v.city, b.booking_date,
       b.total_amount, b.booking_status, p.payment_status, p.payment_method
FROM bookings b JOIN users u ON b.user_id = u.user_id JOIN shows e ON b.show_id = e.show_id
JOIN venues v ON e.venue_id = v.venue_id LEFT JOIN payments p ON b.booking_id = p.booking_id""")

ORACLE["booking_report"] = q("""
SELECT b.booking_id, u.full_name AS customer, e.title AS event_name, b.total_amount, b.booking_status AS status
FROM bookings b JOIN users u ON b.user_id = u.user_id JOIN shows e ON b.show_id = e.show_id
ORDER BY b.booking_id""")

ORACLE["seats_available"] = q("""
SELECT r.request_id, r.seat_id, CAST(coalesce(s.is_available, 0) AS INTEGER) AS is_available
FROM req_seats_ r LEFT JOIN seats s ON s.seat_id = r.seat_id""", _REQ_SEATS)

ORACLE["seats_of_show_in"] = q("""
SELECT r.seat_id, r.show_id, r.request_id, s.is_available, s.price
FROM req_seats_ r JOIN seats s ON s.seat_id = r.seat_id AND s.show_id = r.show_id""", _REQ_SEATS)

ORACLE["booking_seat_lines"] = q("SELECT * FROM seat_lines_", _SEAT_LINES)

ORACLE["booking_food_lines"] = q("""
SELECT bf.booking_id, bf.food_id, f.food_name, bf.quantity, f.price,
       CAST(f.price * bf.quantity AS DECIMAL(18,2)) AS subtotal
FROM booking_food bf JOIN food_items f ON f.food_id = bf.food_id""")

ORACLE["seat_labels"] = q("""
SELECT booking_id, string_agg(row_letter || seat_number, ', ' ORDER BY row_letter, seat_number) AS seat_labels
FROM seat_lines_ GROUP BY booking_id""", _SEAT_LINES)

ORACLE["booking_cost"] = q("""
SELECT b.booking_id, CAST(coalesce(st.s, 0) AS DECIMAL(18,2)) AS seat_total,
       CAST(coalesce(ft.f, 0) AS DECIMAL(18,2)) AS food_total,
       CAST(coalesce(st.s, 0) + coalesce(ft.f, 0) AS DECIMAL(18,2)) AS total_cost
FROM bookings b
LEFT JOIN (SELECT booking_id, sum(price) AS s FROM seat_lines_ GROUP BY 1) st ON st.booking_id = b.booking_id
LEFT JOIN (SELECT bf.booking_id, sum(f.price * bf.quantity) AS f FROM booking_food bf
           JOIN food_items f ON f.food_id = bf.food_id GROUP BY 1) ft ON ft.booking_id = b.booking_id""", _SEAT_LINES)

ORACLE["booking_documents"] = q("""
SELECT b.booking_id, b.user_id, b.show_id, e.title, v.venue_name, b.booking_status, b.total_amount,
       p.payment_status, CAST(coalesce(sl.n, 0) AS INTEGER) AS n_seats, coalesce(sl.txt, '') AS seat_list,
       CAST(coalesce(fl.n, 0) AS INTEGER) AS n_food, coalesce(fl.txt, '') AS food_list
FROM bookings b JOIN shows e ON e.show_id = b.show_id JOIN venues v ON v.venue_id = e.venue_id
LEFT JOIN payments p ON p.booking_id = b.booking_id
LEFT JOIN (SELECT booking_id, count(*) AS n,
                  string_agg(row_letter || seat_number, ' ' ORDER BY row_letter, seat_number, seat_id) AS txt
           FROM seat_lines_ GROUP BY 1) sl ON sl.booking_id = b.booking_id
LEFT JOIN (SELECT bf.booking_id, count(*) AS n,
                  string_agg(bf.food_id || 'x' || bf.quantity, ' '
                             ORDER BY bf.food_id, f.food_name, bf.quantity) AS txt
           FROM booking_food bf JOIN food_items f ON f.food_id = bf.food_id GROUP BY 1) fl
  ON fl.booking_id = b.booking_id""", _SEAT_LINES)

ORACLE["my_bookings"] = q("""
SELECT b.booking_id, b.user_id, b.show_id, b.booking_date, e.title, p.payment_status,
       CAST(coalesce(sl.n, 0) AS INTEGER) AS n_seats, CAST(coalesce(fl.n, 0) AS INTEGER) AS n_food
FROM bookings b JOIN shows e ON e.show_id = b.show_id JOIN venues v ON v.venue_id = e.venue_id
LEFT JOIN payments p ON p.booking_id = b.booking_id
LEFT JOIN (SELECT booking_id, count(*) AS n FROM seat_lines_ GROUP BY 1) sl ON sl.booking_id = b.booking_id
LEFT JOIN (SELECT bf.booking_id, count(*) AS n FROM booking_food bf JOIN food_items f ON f.food_id = bf.food_id
           GROUP BY 1) fl ON fl.booking_id = b.booking_id
WHERE b.user_id IN (SELECT user_id FROM users)""", _SEAT_LINES)

ORACLE["bookings_admin"] = q("""
SELECT b.booking_id, b.user_id, u.full_name, u.email, b.show_id, e.title, b.booking_date, b.total_amount,
       b.booking_status, p.payment_status, p.payment_method
FROM bookings b JOIN users u ON u.user_id = b.user_id JOIN shows e ON e.show_id = b.show_id
LEFT JOIN payments p ON p.booking_id = b.booking_id
ORDER BY b.booking_date DESC, b.booking_id DESC""")

ORACLE["ticket_manifest"] = q("""
SELECT b.booking_id, u.full_name, u.email, e.title, e.show_date, e.show_time, v.venue_name, v.city,
       b.total_amount, b.booking_status, sl.txt AS seat_list, sl.n AS n_seats
FROM bookings b JOIN users u ON u.user_id = b.user_id JOIN shows e ON e.show_id = b.show_id
JOIN venues v ON v.venue_id = e.venue_id
JOIN (SELECT booking_id, count(*) AS n,
             string_agg(row_letter || seat_number || '(' || seat_type || ')', ', '
                        ORDER BY row_letter, seat_number, seat_type) AS txt
      FROM seat_lines_ GROUP BY 1) sl ON sl.booking_id = b.booking_id""", _SEAT_LINES)

ORACLE["visible_to"] = q("""
SELECT a.booking_id, a.actor_id, a.actor_is_admin,
       (b.user_id IS NOT NULL AND (b.user_id = a.actor_id OR a.actor_is_admin)) AS visible
FROM access_ a LEFT JOIN bookings b ON b.booking_id = a.booking_id""", _ACCESS)

ORACLE["payment_detail"] = q("""
SELECT a.booking_id, a.actor_id, p.payment_id, p.amount, p.payment_method, p.payment_status, p.paid_at,
       b.user_id, b.booking_status, e.title AS event_title, (b.user_id = a.actor_id OR a.actor_is_admin) AS visible
FROM access_ a JOIN payments p ON p.booking_id = a.booking_id JOIN bookings b ON b.booking_id = a.booking_id
JOIN shows e ON e.show_id = b.show_id""", _ACCESS)

ORACLE["user_profile"] = q("SELECT user_id, full_name, email, is_admin, created_at FROM users")
ORACLE["payments_by_status"] = q("SELECT * FROM payments WHERE payment_status = 'SUCCESS'")

ORACLE["payments_admin"] = q("""
SELECT p.payment_id, p.booking_id, p.amount, p.payment_method, p.payment_status, p.paid_at, b.booking_status,
       u.full_name, u.email, e.title AS event_title
FROM payments p JOIN bookings b ON p.booking_id = b.booking_id JOIN users u ON u.user_id = b.user_id
JOIN shows e ON e.show_id = b.show_id ORDER BY p.paid_at DESC NULLS LAST, p.payment_id DESC""")

ORACLE["food_menu"] = q("SELECT * FROM food_items WHERE is_veg = 1 ORDER BY food_name, food_id")

ORACLE["has_booked"] = q("""
SELECT DISTINCT r.user_id, r.show_id,
       EXISTS (SELECT 1 FROM bookings b WHERE b.user_id = r.user_id AND b.show_id = r.show_id
               AND b.booking_status = 'CONFIRMED') AS has_booked
FROM review_req_ r""", _REVIEW_REQ)

ORACLE["has_reviewed"] = q("""
SELECT p.user_id, p.show_id, (r.review_id IS NOT NULL) AS has_reviewed, r.review_id, r.rating, r.comment
FROM (SELECT DISTINCT user_id, show_id FROM review_req_) p
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, show_id ORDER BY review_id) AS rn
                          FROM reviews) WHERE rn = 1) r
  ON r.user_id = p.user_id AND r.show_id = p.show_id""", _REVIEW_REQ)

ORACLE["show_reviews"] = q("""
SELECT r.review_id, r.show_id, r.user_id, u.full_name, r.rating, r.comment, r.reviewed_at,
       CAST(CAST((200 * a.s + a.n) // (2 * a.n) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(3,2)) AS live_avg_rating,
       CAST(a.n AS BIGINT) AS review_count
FROM reviews r JOIN users u ON u.user_id = r.user_id
JOIN (SELECT show_id, sum(rating) AS s, count(*) AS n FROM reviews GROUP BY 1) a ON a.show_id = r.show_id
ORDER BY r.show_id, r.reviewed_at DESC, r.review_id DESC""")

ORACLE["my_reviews"] = q("""
SELECT r.review_id, r.user_id, r.show_id, e.title, e.show_date, v.venue_name, v.city, r.rating, r.comment,
       r.reviewed_at
FROM reviews r JOIN shows e ON e.show_id = r.show_id JOIN venues v ON v.venue_id = e.venue_id
ORDER BY r.user_id, r.reviewed_at DESC, r.review_id DESC""")

ORACLE["seat_detail"] = q("""
SELECT s.*, e.title AS event_title FROM seats s JOIN shows e ON e.show_id = s.show_id
WHERE s.seat_id IN (SELECT seat_id FROM booking_seats)""")

ORACLE["reminders_due"] = q(f"""
SELECT b.booking_id, b.total_amount, u.user_id, u.full_name, u.email, e.show_id, e.title, e.show_date,
       e.show_time, v.venue_name, v.city,
       string_agg(s.row_letter || s.seat_number, ', ' ORDER BY s.row_letter, s.seat_number) AS seat_labels
FROM bookings b JOIN users u ON b.user_id = u.user_id JOIN shows e ON b.show_id = e.show_id
JOIN venues v ON e.venue_id = v.venue_id JOIN booking_seats bs ON b.booking_id = bs.booking_id
JOIN seats s ON bs.seat_id = s.seat_id
WHERE b.booking_status = 'CONFIRMED' AND e.show_date = {_AS_OF} + 1
  AND (b.reminder_sent IS NULL OR b.reminder_sent = 0)
GROUP BY ALL""")

ORACLE["review_requests_due"] = q(f"""
SELECT b.booking_id, b.total_amount, u.user_id, u.full_name, u.email, e.show_id, e.title
FROM bookings b JOIN users u ON b.user_id = u.user_id JOIN shows e ON b.show_id = e.show_id
LEFT JOIN reviews r ON r.user_id = b.user_id AND r.show_id = b.show_id
WHERE b.booking_status = 'CONFIRMED' AND e.show_date = {_AS_OF} - 1 AND r.review_id IS NULL""")

ORACLE["mark_reminded"] = q(f"""
SELECT b.booking_id, b.user_id, b.show_id, b.booking_date, b.total_amount, b.booking_status,
       CASE WHEN d.booking_id IS NOT NULL THEN 1 ELSE b.reminder_sent END AS reminder_sent
FROM bookings b LEFT JOIN (
  SELECT DISTINCT b.booking_id FROM bookings b JOIN shows e ON b.show_id = e.show_id
  JOIN booking_seats bs ON b.booking_id = bs.booking_id
  WHERE b.booking_status = 'CONFIRMED' AND e.show_date = {_AS_OF} + 1 AND coalesce(b.reminder_sent, 0) = 0) d
  ON d.booking_id = b.booking_id""")

_WRAP_A = '<section><header>Box Office</header>'
_WRAP_B = '</section>'
ORACLE["outbox_messages"] = q(f"""
SELECT email AS "to", 'Welcome to Box Office!' AS subject,
       '{_WRAP_A}' || '<h2>Welcome, ' || full_name || '!</h2><p>Your account is ready.</p>' || '{_WRAP_B}' AS html,
       'welcome' AS template, 'welcome:' || user_id AS message_id
FROM users
UNION ALL
SELECT u.email, 'Reminder: ' || e.title || ' is tomorrow!',
       '{_WRAP_A}' || '<h2>See you tomorrow at ' || e.title || '!</h2>' || '{_WRAP_B}', 'reminder',
       'reminder:' || b.booking_id
FROM bookings b JOIN users u ON b.user_id = u.user_id JOIN shows e ON b.show_id = e.show_id
WHERE b.booking_status = 'CONFIRMED' AND e.show_date = {_AS_OF} + 1 AND coalesce(b.reminder_sent, 0) = 0
  AND b.booking_id IN (SELECT booking_id FROM booking_seats)
UNION ALL
SELECT u.email, 'Booking Cancelled – ' || e.title,
       '{_WRAP_A}' || '<h2>Booking #' || b.booking_id || ' Cancelled</h2>' || '{_WRAP_B}', 'cancellation',
       'cancellation:' || b.booking_id
FROM bookings b JOIN users u ON b.user_id = u.user_id JOIN shows e ON b.show_id = e.show_id
WHERE b.booking_status = 'CANCELLED'""")

ORACLE["format_inr"] = q("""
SELECT booking_id, total_amount,
       '₹' || CASE WHEN ip < 1000 THEN CAST(ip AS VARCHAR)
                   ELSE array_to_string(list_concat([substr(h, 1, f)],
                          list_transform(range(0, (length(h) - f) // 2), lambda i: substr(h, f + 1 + 2 * i, 2))), ',')
                        || ',' || lpad(CAST(ip % 1000 AS VARCHAR), 3, '0') END
           || '.' || lpad(CAST(CAST(round((total_amount - ip) * 100) AS BIGINT) AS VARCHAR), 2, '0') AS amount_text
FROM (SELECT booking_id, total_amount, CAST(floor(total_amount) AS BIGINT) AS ip,
             CAST(CAST(floor(total_amount) AS BIGINT) // 1000 AS VARCHAR) AS h,
             2 - length(CAST(CAST(floor(total_amount) AS BIGINT) // 1000 AS VARCHAR)) % 2 AS f
      FROM bookings)""")

ORACLE["format_long_date"] = q("""
SELECT show_id, show_date, strftime(show_date, '%A, %-d %B %Y') AS date_text FROM shows""")

ORACLE["parse_seat_labels"] = q("""
SELECT booking_id, CAST(row_number() OVER (PARTITION BY booking_id ORDER BY row_letter, seat_number) - 1 AS INTEGER)
         AS pos, row_letter, seat_number
FROM seat_lines_""", _SEAT_LINES)

ORACLE["seat_map"] = q("""
SELECT r.show_id, e.title AS show_title, r.row_letter, t.total, t.available, t.total - t.available AS booked,
       r.n AS row_seats, r.layout AS row_layout
FROM (SELECT show_id, row_letter, count(*) AS n,
             string_agg(seat_number || CASE WHEN is_available = 1 THEN '' ELSE 'x' END, ' ' ORDER BY seat_number)
               AS layout
      FROM seats GROUP BY 1, 2) r
JOIN (SELECT show_id, count(*) AS total, CAST(sum(is_available) AS BIGINT) AS available FROM seats GROUP BY 1) t
  ON t.show_id = r.show_id
JOIN shows e ON e.show_id = r.show_id""")

ORACLE["refresh_availability"] = q("SELECT * FROM seats")

# --------------------------------------------------------------------------
# apply jobs
# --------------------------------------------------------------------------
_ALLOC = r"""
rl_ AS (
  SELECT l.l_orderkey AS request_id, b.booking_date AS requested_at, b.user_id, b.show_id, l.l_linenumber,
         l.l_suppkey, l.l_returnflag,
         b.show_id * 1000 + (l.l_linenumber - 1) * 100 + CAST(l.l_quantity AS BIGINT) AS seat_id
  FROM lineitem l JOIN bookings b ON b.booking_id = l.l_orderkey),
sc_ AS (
  SELECT r.request_id, any_value(r.requested_at) AS requested_at, any_value(r.user_id) AS user_id,
         any_value(r.show_id) AS show_id, count(*) = count(DISTINCT s.seat_id) AS seat_ok,
         sum(s.price) AS seat_total, list(r.seat_id) AS seats
  FROM rl_ r LEFT JOIN seats s ON s.seat_id = r.seat_id AND s.show_id = r.show_id GROUP BY r.request_id),
fc_ AS (
  SELECT r.request_id, count(*) = count(DISTINCT f.food_id) AS food_ok, sum(f.price * r.l_linenumber) AS food_total
  FROM rl_ r LEFT JOIN food_items f
    ON f.food_id = r.l_suppkey + CASE WHEN r.request_id % 50 = 0 THEN 100000 ELSE 0 END
  WHERE r.l_returnflag = 'R' GROUP BY r.request_id),
ck_ AS (SELECT sc_.*, coalesce(fc_.food_ok, true) AS food_ok, fc_.food_total FROM sc_ LEFT JOIN fc_ USING (request_id)),
od_ AS (SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY requested_at, request_id) AS rn FROM ck_ WHERE seat_ok),
rec_ AS (
  SELECT show_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS request_id,
         CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS unavail
  FROM (SELECT DISTINCT show_id FROM od_)
  UNION ALL
  SELECT o.show_id, o.rn,
         CASE WHEN NOT list_has_any(r.taken, o.seats) AND o.food_ok THEN list_concat(r.taken, o.seats) ELSE r.taken END,
         o.request_id,
         CASE WHEN list_has_any(r.taken, o.seats) THEN 'CONFLICT' WHEN NOT o.food_ok THEN 'INVALID_FOOD'
              ELSE 'ACCEPTED' END,
         array_to_string(list_sort(list_distinct(list_filter(o.seats, lambda x: list_contains(r.taken, x)))), ',')
  FROM rec_ r JOIN od_ o ON o.show_id = r.show_id AND o.rn = r.rn + 1),
dec_ AS (SELECT request_id, outcome, unavail FROM rec_ WHERE request_id IS NOT NULL),
acc_ AS (SELECT c.request_id, row_number() OVER (ORDER BY c.requested_at, c.request_id) AS booking_id
         FROM ck_ c JOIN dec_ d USING (request_id) WHERE d.outcome = 'ACCEPTED')
"""
ORACLE["allocate_seats"] = q("""
SELECT c.request_id, c.user_id, c.show_id,
       CASE WHEN NOT c.seat_ok THEN 'INVALID_SEAT' ELSE d.outcome END AS outcome,
       CAST(a.booking_id AS BIGINT) AS booking_id,
       CASE WHEN a.booking_id IS NOT NULL THEN CAST(c.seat_total + coalesce(c.food_total, 0) AS DECIMAL(10,2)) END
         AS total_amount,
       CASE WHEN d.outcome = 'CONFLICT' THEN d.unavail END AS unavailable_seats
FROM ck_ c LEFT JOIN dec_ d USING (request_id) LEFT JOIN acc_ a USING (request_id)""", _ALLOC, recursive=True)

_QUICK = r"""
qr_ AS (
  SELECT booking_id * 10 + 8 AS request_id, booking_date + INTERVAL 3 HOUR AS requested_at, user_id, show_id,
         show_id * 1000 + (booking_id % 7) * 100 + 1 + booking_id % 48 AS s1, booking_id % 1200 AS food_id,
         booking_id % 3 AS qty
  FROM bookings),
qc_ AS (
  SELECT q.*, [q.s1, q.s1 + 1] AS seats, (x1.seat_id IS NOT NULL AND x2.seat_id IS NOT NULL) AS seat_ok,
         x1.price + x2.price AS seat_total,
         (NOT (q.food_id > 0 AND q.qty > 0) OR f.food_id IS NOT NULL) AS food_ok
  FROM qr_ q LEFT JOIN seats x1 ON x1.seat_id = q.s1 LEFT JOIN seats x2 ON x2.seat_id = q.s1 + 1
  LEFT JOIN food_items f ON f.food_id = q.food_id),
od_ AS (SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY requested_at, request_id) AS rn FROM qc_ WHERE seat_ok),
t0_ AS (SELECT show_id, list(seat_id) AS t FROM seats WHERE is_available = 0 GROUP BY show_id),
rec_ AS (
  SELECT d.show_id, CAST(0 AS BIGINT) AS rn, coalesce(t0_.t, CAST([] AS BIGINT[])) AS taken,
         CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS unavail
  FROM (SELECT DISTINCT show_id FROM od_) d LEFT JOIN t0_ USING (show_id)
  UNION ALL
  SELECT o.show_id, o.rn,
         CASE WHEN NOT list_has_any(r.taken, o.seats) AND o.food_ok THEN list_concat(r.taken, o.seats) ELSE r.taken END,
         o.request_id,
         CASE WHEN list_has_any(r.taken, o.seats) THEN 'CONFLICT' WHEN NOT o.food_ok THEN 'INVALID_FOOD'
              ELSE 'ACCEPTED' END,
         array_to_string(list_sort(list_distinct(list_filter(o.seats, lambda x: list_contains(r.taken, x)))), ',')
  FROM rec_ r JOIN od_ o ON o.show_id = r.show_id AND o.rn = r.rn + 1),
dec_ AS (SELECT request_id, outcome, unavail FROM rec_ WHERE request_id IS NOT NULL),
acc_ AS (SELECT c.request_id, (SELECT max(booking_id) FROM bookings)
                              + row_number() OVER (ORDER BY c.requested_at, c.request_id) AS booking_id
         FROM qc_ c JOIN dec_ d USING (request_id) WHERE d.outcome = 'ACCEPTED')
"""
ORACLE["quick_book_two"] = q("""
SELECT c.request_id, CASE WHEN NOT c.seat_ok THEN 'INVALID_SEAT' ELSE d.outcome END AS outcome,
       CAST(a.booking_id AS BIGINT) AS booking_id,
       CASE WHEN a.booking_id IS NOT NULL THEN CAST(c.seat_total AS DECIMAL(10,2)) END AS total_amount,
       CASE WHEN d.outcome = 'CONFLICT' THEN d.unavail END AS unavailable_seats
FROM qc_ c LEFT JOIN dec_ d USING (request_id) LEFT JOIN acc_ a USING (request_id)""", _QUICK, recursive=True)

ORACLE["register_users"] = q(r"""
SELECT request_id, email, outcome,
       CAST(CASE WHEN outcome = 'ACCEPTED' THEN (SELECT max(user_id) FROM users)
            + row_number() OVER (PARTITION BY outcome = 'ACCEPTED' ORDER BY requested_at, request_id) END AS BIGINT)
         AS user_id
FROM (SELECT v.request_id, v.email, v.requested_at,
             CASE WHEN NOT v.valid THEN 'INVALID' WHEN v.known OR NOT f.first THEN 'DUPLICATE' ELSE 'ACCEPTED' END
               AS outcome
      FROM rv_ v LEFT JOIN rf_ f USING (request_id))""", r"""
rr_ AS (
  SELECT c_custkey AS request_id, TIMESTAMP '2001-01-01 00:00:00' + to_minutes(c_custkey) AS requested_at,
         CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_name END AS full_name,
         CASE WHEN c_custkey % 50 = 0 THEN 'U' || c_custkey || '@example.test'
              ELSE (CASE WHEN c_custkey % 2 = 0 THEN 'New' ELSE 'new' END) || (c_custkey // 2) || '@Example.test'
         END AS email, CASE WHEN c_custkey % 89 = 0 THEN 5 ELSE 6 + c_custkey % 7 END AS pw
  FROM customer),
rv_ AS (
  SELECT r.*, (coalesce(length(trim(full_name)), 0) > 0
               AND coalesce(regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$'), false) AND pw >= 6) AS valid,
         lower(email) IN (SELECT lower(email) FROM users) AS known
  FROM rr_ r),
rf_ AS (SELECT request_id, row_number() OVER (PARTITION BY lower(email) ORDER BY requested_at, request_id) = 1 AS first
        FROM rv_ WHERE valid AND NOT known)
""")

_CANCEL = """
cr_ AS (
  SELECT booking_id * 10 + 3 AS request_id, booking_date + INTERVAL 2 DAY AS requested_at,
         CASE WHEN booking_id % 49 = 0 THEN -booking_id - 1 ELSE booking_id END AS booking_id,
         CASE WHEN booking_id % 7 <> 0 OR booking_id % 21 = 0 THEN user_id + 1 ELSE user_id END AS actor_id
  FROM bookings),
cj_ AS (SELECT r.*, r.actor_id % 100 = 0 AS adm, b.user_id AS owner, b.booking_status AS st
        FROM cr_ r LEFT JOIN bookings b USING (booking_id)),
cf_ AS (SELECT request_id, row_number() OVER (PARTITION BY booking_id ORDER BY requested_at, request_id) = 1 AS first
        FROM cj_ WHERE owner IS NOT NULL AND (coalesce(owner = actor_id, false) OR coalesce(adm, false)))
"""
ORACLE["cancel_bookings"] = q("""
SELECT j.request_id, j.booking_id, j.actor_id,
       CASE WHEN j.owner IS NULL THEN 'NOT_FOUND' WHEN f.first IS NULL THEN 'FORBIDDEN'
            WHEN j.st = 'CANCELLED' OR NOT f.first THEN 'ALREADY_CANCELLED' ELSE 'CANCELLED' END AS outcome
FROM cj_ j LEFT JOIN cf_ f USING (request_id)""", _CANCEL)

_PAY = """
pr_ AS (
  SELECT b.booking_id * 10 + 5 + c.c AS request_id, b.booking_date + to_hours(c.c) AS requested_at, b.booking_id,
         CASE WHEN b.booking_id % 65 = 0 THEN NULL WHEN b.booking_id % 35 = 0 THEN b.user_id + 1 ELSE b.user_id END AS actor_id,
         CASE WHEN c.c = 2 THEN 'SUCCESS' WHEN b.booking_id % 5 <> 0 OR b.booking_id % 45 = 0 THEN 'REFUNDED'
              WHEN b.booking_id % 10 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS payment_status,
         CASE WHEN b.booking_id % 20 = 0 THEN NULL ELSE 'Credit Card' END AS payment_method
  FROM bookings b, range(1, 3) c(c) WHERE c.c = 1 OR b.booking_id % 25 = 0),
po_ AS (
  SELECT r.*, CASE WHEN r.payment_status NOT IN ('SUCCESS', 'FAILED') THEN 'INVALID_STATUS'
                   WHEN p.booking_id IS NULL THEN 'NOT_FOUND'
                   WHEN NOT (coalesce(b.user_id = r.actor_id, false) OR coalesce(r.actor_id % 100 = 0, false)) THEN 'FORBIDDEN'
                   ELSE 'APPLIED' END AS outcome
  FROM pr_ r LEFT JOIN payments p USING (booking_id) LEFT JOIN bookings b USING (booking_id)),
la_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY booking_id ORDER BY requested_at DESC, request_id DESC) AS rn
                       FROM po_ WHERE outcome = 'APPLIED') WHERE rn = 1),
lm_ AS (SELECT * FROM (SELECT booking_id, payment_method,
                              row_number() OVER (PARTITION BY booking_id ORDER BY requested_at DESC, request_id DESC) AS rn
                       FROM po_ WHERE outcome = 'APPLIED' AND payment_method IS NOT NULL) WHERE rn = 1)
"""
ORACLE["apply_payment_results"] = q("""
SELECT request_id, booking_id, actor_id, payment_status, outcome,
       CASE WHEN outcome = 'APPLIED' THEN CASE WHEN payment_status = 'SUCCESS' THEN 'CONFIRMED' ELSE 'CANCELLED' END END
         AS booking_status
FROM po_""", _PAY)

ORACLE["payments_after_results"] = q("""
SELECT p.booking_id, p.payment_id, p.amount, coalesce(lm.payment_method, p.payment_method) AS payment_method,
       coalesce(la.payment_status, p.payment_status) AS payment_status,
       CASE WHEN la.booking_id IS NULL THEN p.paid_at WHEN la.payment_status = 'SUCCESS' THEN la.requested_at END AS paid_at,
       CASE WHEN la.booking_id IS NULL THEN b.booking_status WHEN la.payment_status = 'SUCCESS' THEN 'CONFIRMED'
            ELSE 'CANCELLED' END AS booking_status
FROM payments p JOIN bookings b USING (booking_id) LEFT JOIN la_ la USING (booking_id)
LEFT JOIN lm_ lm USING (booking_id)""", _PAY)

ORACLE["release_failed_seats"] = q("""
SELECT s.seat_id, s.show_id, 1 AS is_available FROM seats s
WHERE s.is_available = 0 AND s.seat_id IN (
  SELECT bs.seat_id FROM booking_seats bs
  WHERE bs.booking_id IN (SELECT booking_id FROM po_ WHERE outcome = 'APPLIED' AND payment_status = 'FAILED'))""", _PAY)

ORACLE["submit_reviews"] = q("""
SELECT request_id, user_id, show_id, outcome,
       CAST(CASE WHEN outcome = 'ACCEPTED' THEN (SELECT max(review_id) FROM reviews)
            + row_number() OVER (PARTITION BY outcome = 'ACCEPTED' ORDER BY requested_at, request_id) END AS BIGINT)
         AS review_id
FROM (SELECT j.request_id, j.user_id, j.show_id, j.requested_at,
             CASE WHEN NOT j.rate_ok THEN 'INVALID' WHEN NOT j.booked THEN 'FORBIDDEN'
                  WHEN j.dup OR NOT f.first THEN 'DUPLICATE' ELSE 'ACCEPTED' END AS outcome
      FROM vj_ j LEFT JOIN vf_ f USING (request_id))""", """
vr_ AS (
  SELECT b.booking_id * 10 + c.c AS request_id, b.booking_date + to_hours(CAST(24 * 31 + c.c AS BIGINT)) AS requested_at,
         b.user_id, b.show_id,
         CASE WHEN b.booking_id % 33 = 0 THEN 6 ELSE 1 + (b.booking_id // 7) % 5 END AS rating
  FROM bookings b, range(1, 3) c(c) WHERE c.c = 1 OR b.booking_id % 15 = 0),
vj_ AS (
  SELECT r.*, r.rating BETWEEN 1 AND 5 AS rate_ok,
         EXISTS (SELECT 1 FROM bookings b WHERE b.user_id = r.user_id AND b.show_id = r.show_id
                 AND b.booking_status = 'CONFIRMED') AS booked,
         EXISTS (SELECT 1 FROM reviews v WHERE v.user_id = r.user_id AND v.show_id = r.show_id) AS dup
  FROM vr_ r),
vf_ AS (SELECT request_id, row_number() OVER (PARTITION BY user_id, show_id ORDER BY requested_at, request_id) = 1 AS first
        FROM vj_ WHERE rate_ok AND booked AND NOT dup)
""")

ORACLE["update_reviews"] = q("""
SELECT o.request_id, o.review_id, o.actor_id, o.outcome,
       CASE WHEN l.review_id IS NOT NULL THEN l.rating ELSE v.rating END AS rating,
       CASE WHEN l.review_id IS NOT NULL THEN l.comment ELSE v.comment END AS comment
FROM uo_ o LEFT JOIN reviews v ON v.review_id = o.review_id LEFT JOIN ul_ l ON l.review_id = o.review_id""", """
ur_ AS (
  SELECT review_id * 10 + 2 AS request_id, reviewed_at + INTERVAL 1 DAY AS requested_at,
         CASE WHEN review_id % 20 = 0 THEN -review_id - 1 ELSE review_id END AS review_id,
         CASE WHEN review_id % 4 = 1 THEN NULL WHEN review_id % 8 = 4 THEN user_id ELSE user_id + 1 END AS actor_id,
         CAST(CASE WHEN review_id % 12 = 0 THEN 0 ELSE rating % 5 + 1 END AS INTEGER) AS rating,
         'Edited ' || review_id AS comment
  FROM reviews),
uo_ AS (
  SELECT r.*, CASE WHEN NOT (r.rating BETWEEN 1 AND 5) THEN 'INVALID' WHEN v.review_id IS NULL THEN 'NOT_FOUND'
                   WHEN v.user_id = r.actor_id THEN 'UPDATED' ELSE 'FORBIDDEN' END AS outcome
  FROM ur_ r LEFT JOIN reviews v USING (review_id)),
ul_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY requested_at DESC, request_id DESC) AS rn
                       FROM uo_ WHERE outcome = 'UPDATED') WHERE rn = 1)
""")

_DEL_REV = """
dr_ AS (
  SELECT review_id * 10 + 3 + c.c AS request_id, reviewed_at + to_days(CAST(2 + c.c AS INTEGER)) AS requested_at, review_id,
         CASE WHEN review_id % 5 = 1 THEN NULL WHEN review_id % 10 = 5 THEN user_id ELSE user_id + 1 END AS actor_id
  FROM reviews, range(1, 3) c(c) WHERE c.c = 1 OR review_id % 35 = 0),
dj_ AS (SELECT r.*, v.user_id AS owner FROM dr_ r LEFT JOIN reviews v USING (review_id)),
df_ AS (SELECT request_id, row_number() OVER (PARTITION BY review_id ORDER BY requested_at, request_id) = 1 AS first
        FROM dj_ WHERE owner IS NOT NULL AND (owner = actor_id OR actor_id % 100 = 0)),
gone_ AS (SELECT review_id FROM dj_ JOIN df_ USING (request_id) WHERE first)
"""
ORACLE["delete_reviews"] = q("""
SELECT j.request_id, j.review_id, j.actor_id,
       CASE WHEN j.owner IS NULL THEN 'NOT_FOUND' WHEN f.first IS NULL THEN 'FORBIDDEN' WHEN NOT f.first THEN 'NOT_FOUND'
            ELSE 'DELETED' END AS outcome
FROM dj_ j LEFT JOIN df_ f USING (request_id)""", _DEL_REV)

ORACLE["refresh_avg_rating"] = q("""
SELECT s.show_id,
       CAST(coalesce(CAST((200 * a.s + a.n) // (2 * a.n) AS DECIMAL(18,0)) * 0.01, 0) AS DECIMAL(3,2)) AS avg_rating
FROM shows s LEFT JOIN (SELECT show_id, sum(rating) AS s, count(*) AS n FROM reviews
                        WHERE review_id NOT IN (SELECT review_id FROM gone_) GROUP BY 1) a USING (show_id)""", _DEL_REV)

_SEATMAP = """
sp_ AS (
  SELECT CASE WHEN p_partkey % 70 = 0 THEN -p_partkey - 1 ELSE p_partkey END AS show_id,
         CASE WHEN p_partkey % 90 = 0 THEN -1 WHEN p_partkey % 20 = 0 THEN 30 ELSE p_partkey % 9 END AS nr0,
         p_partkey % 13 AS pr0, p_partkey % 3 AS vr0
  FROM part),
sd_ AS (SELECT show_id, CASE WHEN nr0 = 0 THEN 5 ELSE nr0 END AS nr, CASE WHEN pr0 = 0 THEN 10 ELSE pr0 END AS pr,
               CASE WHEN vr0 = 0 THEN 1 ELSE vr0 END AS vr, 2 AS pm FROM sp_),
ok_ AS (SELECT d.* FROM sd_ d WHERE d.show_id IN (SELECT show_id FROM shows) AND d.nr >= 1 AND d.pr >= 1)
"""
ORACLE["generate_seat_map"] = q("""
SELECT seat_id, show_id, row_letter, seat_number, seat_type, is_available, price FROM seats
WHERE show_id NOT IN (SELECT show_id FROM ok_)
UNION ALL
SELECT (SELECT max(seat_id) FROM seats) + row_number() OVER (ORDER BY show_id, r, n), show_id,
       chr(CAST(64 + r AS INTEGER)), CAST(n AS INTEGER),
       CASE WHEN r <= vr THEN 'VIP' WHEN r <= vr + pm THEN 'PREMIUM' ELSE 'REGULAR' END, 1,
       CAST(CASE WHEN r <= vr THEN 1200 WHEN r <= vr + pm THEN 800 ELSE 500 END AS DECIMAL(10,2))
FROM (SELECT show_id, vr, pm, r, unnest(range(1, pr + 1)) AS n
      FROM (SELECT show_id, vr, pm, pr, unnest(range(1, least(nr, 26) + 1)) AS r FROM ok_))""", _SEATMAP)

ORACLE["seat_map_outcomes"] = q("""
SELECT d.show_id,
       CASE WHEN d.show_id NOT IN (SELECT show_id FROM shows) THEN 'NOT_FOUND'
            WHEN d.nr < 1 OR d.pr < 1 THEN 'INVALID' ELSE 'GENERATED' END AS outcome,
       CAST(CASE WHEN d.show_id IN (SELECT show_id FROM shows) AND d.nr >= 1 AND d.pr >= 1
                 THEN least(d.nr, 26) * d.pr ELSE 0 END AS INTEGER) AS seats_generated
FROM sd_ d""", _SEATMAP)

ORACLE["create_shows"] = q("""
SELECT request_id, title, outcome,
       CAST(CASE WHEN outcome = 'CREATED' THEN (SELECT max(show_id) FROM shows)
            + row_number() OVER (PARTITION BY outcome = 'CREATED' ORDER BY requested_at, request_id) END AS BIGINT) AS show_id
FROM (SELECT p_partkey * 10 + 9 AS request_id, TIMESTAMP '2001-03-01 00:00:00' + to_minutes(p_partkey) AS requested_at,
             p_name || ' (encore)' AS title,
             CASE WHEN p_partkey % 300 = 0 THEN 'INVALID' WHEN p_partkey % 7 = 0 THEN 'INVALID_REFERENCE' ELSE 'CREATED' END
               AS outcome
      FROM part)""")

_PATCH = """
pt_ AS (
  SELECT p_partkey * 10 + 7 AS request_id, CASE WHEN p_partkey % 70 = 0 THEN -p_partkey - 1 ELSE p_partkey END AS show_id,
         p_partkey AS k, p_name, p_retailprice,
         CASE WHEN p_partkey % 50 = 0 OR p_partkey % 10 > 5 THEN 'NO_FIELDS'
              WHEN p_partkey % 70 = 0 THEN 'UPDATED'
              WHEN p_partkey % 10 IN (1, 3, 4) THEN 'INVALID'
              WHEN p_partkey % 10 = 2 THEN 'INVALID_REFERENCE' ELSE 'UPDATED' END AS outcome
  FROM part)
"""
ORACLE["update_shows"] = q("""
SELECT s.show_id,
       CASE WHEN p.k % 20 = 0 THEN upper(p.p_name) ELSE s.title END AS title,
       CASE WHEN p.k % 40 = 0 THEN NULL ELSE s.description END AS description,
       s.show_date,
       CASE WHEN p.k % 10 = 0 AND p.k % 20 <> 0 AND p.k % 30 <> 0 AND p.k % 40 <> 0 THEN '20:30:00'
            ELSE s.show_time END AS show_time,
       CASE WHEN p.k % 10 = 5 THEN CAST(p.k % 25 AS BIGINT) ELSE s.venue_id END AS venue_id, s.category_id,
       CASE WHEN p.k % 30 = 0 THEN CAST(p.p_retailprice + 1 AS DECIMAL(10,2)) ELSE s.base_price END AS base_price,
       s.avg_rating
FROM shows s LEFT JOIN (SELECT * FROM pt_ WHERE outcome = 'UPDATED') p ON p.show_id = s.show_id""", _PATCH)
ORACLE["update_shows_outcomes"] = q("SELECT request_id, show_id, outcome FROM pt_", _PATCH)

ORACLE["delete_shows"] = q("""
SELECT CASE WHEN show_id IN (SELECT show_id FROM shows) THEN 'DELETED' ELSE 'NOT_FOUND' END AS item, count(*) AS n
FROM rq_ GROUP BY 1
UNION ALL SELECT 'shows', count(*) FROM shows WHERE show_id NOT IN (SELECT show_id FROM gs_)
UNION ALL SELECT 'bookings', count(*) FROM bookings WHERE booking_id NOT IN (SELECT booking_id FROM gb_)
UNION ALL SELECT 'seats', count(*) FROM seats WHERE show_id NOT IN (SELECT show_id FROM gs_)
UNION ALL SELECT 'reviews', count(*) FROM reviews WHERE show_id NOT IN (SELECT show_id FROM gs_)
UNION ALL SELECT 'payments', count(*) FROM payments WHERE booking_id NOT IN (SELECT booking_id FROM gb_)
UNION ALL SELECT 'booking_seats', count(*) FROM booking_seats WHERE booking_id NOT IN (SELECT booking_id FROM gb_)
UNION ALL SELECT 'booking_food', count(*) FROM booking_food WHERE booking_id NOT IN (SELECT booking_id FROM gb_)""", """
gs_ AS (SELECT show_id FROM shows WHERE show_id IN (SELECT p_partkey FROM part WHERE p_partkey % 25 = 0)),
gb_ AS (SELECT booking_id FROM bookings WHERE show_id IN (SELECT show_id FROM gs_)),
rq_ AS (SELECT p_partkey * 10 + 4 AS request_id,
               CASE WHEN p_partkey % 25 = 0 THEN p_partkey ELSE -p_partkey - 1 END AS show_id FROM part
        UNION ALL
        SELECT p_partkey * 10 + 5, -p_partkey - 1 FROM part WHERE p_partkey % 100 = 0)
""")

ORACLE["add_food_items"] = q("""
SELECT request_id, food_name, outcome,
       CAST(CASE WHEN outcome = 'CREATED' THEN (SELECT max(food_id) FROM food_items)
            + row_number() OVER (PARTITION BY outcome = 'CREATED' ORDER BY requested_at, request_id) END AS BIGINT)
         AS food_id
FROM (SELECT s_suppkey * 10 + 1 AS request_id, TIMESTAMP '2001-04-01 00:00:00' + to_minutes(s_suppkey) AS requested_at,
             'Snack ' || s_suppkey AS food_name,
             CASE WHEN s_suppkey % 30 = 0 THEN 'INVALID' ELSE 'CREATED' END AS outcome
      FROM supplier)""")

# --------------------------------------------------------------------------
# audits, validation, paging, sinks
# --------------------------------------------------------------------------
def _unique_sql() -> str:
    rules = [("categories", ["category_id"], "primary_key"), ("venues", ["venue_id"], "primary_key"),
             ("users", ["user_id"], "primary_key"), ("shows", ["show_id"], "primary_key"),
             ("seats", ["seat_id"], "primary_key"), ("bookings", ["booking_id"], "primary_key"),
             ("booking_seats", ["bs_id"], "primary_key"), ("food_items", ["food_id"], "primary_key"),
             ("booking_food", ["bf_id"], "primary_key"), ("payments", ["payment_id"], "primary_key"),
             ("reviews", ["review_id"], "primary_key"), ("categories", ["category_name"], "unique"),
             ("users", ["email"], "unique"), ("seats", ["show_id", "row_letter", "seat_number"], "unique"),
             ("booking_seats", ["booking_id", "seat_id"], "unique"), ("payments", ["booking_id"], "unique"),
             ("reviews", ["user_id", "show_id"], "unique")]
    parts = []
    for t, cols, kind in rules:
        sel = ", ".join(f"lower({c}) AS {c}" if c in ("email", "category_name") else c for c in cols)
        key = " || ',' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
        parts.append(f"SELECT '{kind}({','.join(cols)})' AS rule, '{t}' AS table_name, {key} AS row_key, "
                     f"'rows=' || count(*) AS detail FROM (SELECT {sel} FROM {t}) GROUP BY ALL HAVING count(*) > 1")
    return "\nUNION ALL\n".join(parts)


def _fk_sql() -> str:
    fks = [("shows", "venue_id", "venues", "show_id"), ("shows", "category_id", "categories", "show_id"),
           ("seats", "show_id", "shows", "seat_id"), ("bookings", "user_id", "users", "booking_id"),
           ("bookings", "show_id", "shows", "booking_id"), ("booking_seats", "booking_id", "bookings", "bs_id"),
           ("booking_seats", "seat_id", "seats", "bs_id"), ("booking_food", "booking_id", "bookings", "bf_id"),
           ("booking_food", "food_id", "food_items", "bf_id"), ("payments", "booking_id", "bookings", "payment_id"),
           ("reviews", "user_id", "users", "review_id"), ("reviews", "show_id", "shows", "review_id")]
    parts = []
    for child, col, parent, pk in fks:
        parts.append(f"SELECT 'fk({col}->{parent})' AS rule, '{child}' AS table_name, CAST({pk} AS VARCHAR) AS row_key, "
                     f"'{col}=' || {col} AS detail FROM {child} WHERE {col} IS NOT NULL "
                     f"AND {col} NOT IN (SELECT {col} FROM {parent})")
    return "\nUNION ALL\n".join(parts)


def _check_sql() -> str:
    checks = [("venues", "capacity>0", "capacity > 0", "capacity", "venue_id"),
              ("shows", "base_price>=0", "base_price >= 0", "base_price", "show_id"),
              ("shows", "avg_rating between 0 and 5", "avg_rating BETWEEN 0 AND 5", "avg_rating", "show_id"),
              ("seats", "price>=0", "price >= 0", "price", "seat_id"),
              ("bookings", "booking_status in domain", "booking_status IN ('CONFIRMED','CANCELLED','PENDING')",
               "booking_status", "booking_id"),
              ("bookings", "total_amount>=0", "total_amount >= 0", "total_amount", "booking_id"),
              ("food_items", "price>=0", "price >= 0", "price", "food_id"),
              ("booking_food", "quantity>0", "quantity > 0", "quantity", "bf_id"),
              ("payments", "amount>=0", "amount >= 0", "amount", "payment_id"),
              ("reviews", "rating between 1 and 5", "rating BETWEEN 1 AND 5", "rating", "review_id")]
    return "\nUNION ALL\n".join(
        f"SELECT 'check({name})' AS rule, '{t}' AS table_name, CAST({pk} AS VARCHAR) AS row_key, "
        f"'{col}=' || coalesce(CAST({col} AS VARCHAR), 'NULL') AS detail FROM {t} WHERE NOT coalesce({cond}, true)"
        for t, name, cond, col, pk in checks)


_NOT_NULL = {
    "categories": ("category_id", ["category_id", "category_name"]),
    "venues": ("venue_id", ["venue_id", "venue_name", "city", "state", "capacity", "address"]),
    "users": ("user_id", ["user_id", "full_name", "email", "password_hash", "is_admin", "created_at"]),
    "shows": ("show_id", ["show_id", "title", "show_date", "show_time", "venue_id", "category_id", "base_price",
                          "avg_rating"]),
    "seats": ("seat_id", ["seat_id", "show_id", "row_letter", "seat_number", "seat_type", "is_available", "price"]),
    "bookings": ("booking_id", ["booking_id", "user_id", "show_id", "booking_date", "total_amount", "booking_status",
                                "reminder_sent"]),
    "booking_seats": ("bs_id", ["bs_id", "booking_id", "seat_id"]),
    "food_items": ("food_id", ["food_id", "food_name", "price", "is_veg"]),
    "booking_food": ("bf_id", ["bf_id", "booking_id", "food_id", "quantity"]),
    "payments": ("payment_id", ["payment_id", "booking_id", "amount", "payment_method", "payment_status"]),
    "reviews": ("review_id", ["review_id", "user_id", "show_id", "rating", "reviewed_at"]),
}


def _not_null_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT 'not_null({c})' AS rule, '{t}' AS table_name, CAST({pk} AS VARCHAR) AS row_key, "
        f"'{c} is NULL' AS detail FROM {t} WHERE {c} IS NULL"
        for t, (pk, cols) in _NOT_NULL.items() for c in cols)


# the audited state: the mapped tables with every kind of violation planted
_BROKEN = """
x_venues AS (SELECT * REPLACE (CASE WHEN venue_id % 10 = 1 THEN 0 ELSE capacity END AS capacity,
                               CASE WHEN venue_id % 12 = 5 THEN NULL ELSE address END AS address) FROM venues),
x_categories AS (SELECT * FROM categories
                 UNION ALL SELECT category_id + 1000000, upper(category_name), description FROM categories WHERE category_id % 50 = 1),
x_users AS (SELECT * REPLACE (CASE WHEN user_id % 50 = 1 THEN 'U' || (user_id + 1) || '@Example.TEST' ELSE email END AS email,
                              CASE WHEN user_id % 40 = 3 THEN NULL ELSE full_name END AS full_name) FROM users),
x_shows AS (SELECT * REPLACE (CASE WHEN show_id % 30 = 1 THEN venue_id + 1000 ELSE venue_id END AS venue_id,
                              CASE WHEN show_id % 30 = 7 THEN -1 ELSE category_id END AS category_id,
                              CASE WHEN show_id % 25 = 2 THEN CAST(-1 AS DECIMAL(10,2)) ELSE base_price END AS base_price,
                              CASE WHEN show_id % 35 = 6 THEN CAST(9.5 AS DECIMAL(3,2)) ELSE avg_rating END AS avg_rating,
                              CASE WHEN show_id % 45 = 4 THEN NULL ELSE title END AS title) FROM shows),
x_seats AS (SELECT * REPLACE (CASE WHEN seat_id % 5000 = 1 THEN 'BALCONY' ELSE seat_type END AS seat_type,
                              CASE WHEN seat_id % 7000 = 2 THEN CAST(-1 AS DECIMAL(10,2)) ELSE price END AS price,
                              CASE WHEN seat_id % 9000 = 3 THEN -show_id - 1 ELSE show_id END AS show_id) FROM seats
            UNION ALL SELECT * FROM seats WHERE seat_id % 8000 = 4),
x_bookings AS (SELECT booking_id, CASE WHEN booking_id % 300 = 4 THEN -5 ELSE user_id END AS user_id,
                      CASE WHEN booking_id % 300 = 8 THEN -6 ELSE show_id END AS show_id, booking_date,
                      CASE WHEN booking_id % 250 = 6 THEN CAST(-1 AS DECIMAL(10,2)) ELSE total_amount END AS total_amount,
                      CASE WHEN booking_id % 200 = 3 THEN 'LOST' WHEN booking_id % 210 = 9 THEN NULL ELSE booking_status END AS booking_status,
                      reminder_sent FROM bookings),
x_booking_seats AS (SELECT bs_id, CASE WHEN booking_id % 400 = 12 THEN -booking_id ELSE booking_id END AS booking_id,
                           CASE WHEN booking_id % 400 = 5 THEN -seat_id ELSE seat_id END AS seat_id FROM booking_seats
                    UNION ALL SELECT * FROM booking_seats WHERE booking_id % 500 = 1),
x_food_items AS (SELECT * REPLACE (CASE WHEN food_id % 10 = 1 THEN CAST(-1 AS DECIMAL(8,2)) ELSE price END AS price) FROM food_items),
x_booking_food AS (SELECT bf_id, CASE WHEN booking_id % 350 = 13 THEN -booking_id ELSE booking_id END AS booking_id,
                          CASE WHEN booking_id % 350 = 2 THEN -7 ELSE food_id END AS food_id,
                          CASE WHEN booking_id % 300 = 1 THEN 0 ELSE quantity END AS quantity FROM booking_food
                   UNION ALL SELECT bf_id, booking_id, food_id, quantity FROM booking_food WHERE booking_id % 450 = 3),
x_payments AS (SELECT payment_id, CASE WHEN booking_id % 600 = 14 THEN -booking_id ELSE booking_id END AS booking_id,
                      CASE WHEN booking_id % 260 = 4 THEN CAST(-1 AS DECIMAL(10,2)) ELSE amount END AS amount,
                      CASE WHEN booking_id % 170 = 2 THEN NULL ELSE payment_method END AS payment_method,
                      CASE WHEN booking_id % 150 = 1 THEN 'UNKNOWN' ELSE payment_status END AS payment_status, paid_at FROM payments
               UNION ALL SELECT payment_id, booking_id, amount, payment_method, payment_status, paid_at FROM payments WHERE booking_id % 550 = 5),
x_reviews AS (SELECT review_id, CASE WHEN review_id % 110 = 7 THEN -8 ELSE user_id END AS user_id,
                     CASE WHEN review_id % 110 = 9 THEN -9 ELSE show_id END AS show_id,
                     CASE WHEN review_id % 100 = 3 THEN 9 ELSE rating END AS rating, comment, reviewed_at FROM reviews
              UNION ALL SELECT review_id, user_id, show_id, rating, comment, reviewed_at FROM reviews WHERE review_id % 120 = 3)
"""


def _broken(sql: str) -> str:
    """The statement over the broken tables."""
    names = "|".join(sorted(_NOT_NULL, key=len, reverse=True))
    return q(re.sub(rf"\bFROM ({names})\b", r"FROM x_\1", sql), _BROKEN)


ORACLE["audit_unique"] = _broken(_unique_sql())
ORACLE["audit_fk"] = _broken(_fk_sql())
ORACLE["audit_check"] = _broken(_check_sql())
ORACLE["audit_not_null"] = _broken(_not_null_sql())
ORACLE["audit_rows"] = _broken(_check_sql() + "\nUNION ALL\n" + _not_null_sql() + """
UNION ALL
SELECT 'domain(seat_type)', 'seats', CAST(seat_id AS VARCHAR), 'seat_type=' || seat_type FROM seats
WHERE seat_type NOT IN ('VIP', 'PREMIUM', 'REGULAR')
UNION ALL
SELECT 'domain(payment_status)', 'payments', CAST(payment_id AS VARCHAR), 'payment_status=' || payment_status
FROM payments WHERE payment_status NOT IN ('PENDING', 'SUCCESS', 'FAILED')""")
ORACLE["audit_domain"] = _broken("""
SELECT 'domain(seat_type)' AS rule, 'seats' AS table_name, CAST(seat_id AS VARCHAR) AS row_key,
       'seat_type=' || seat_type AS detail FROM seats WHERE seat_type NOT IN ('VIP', 'PREMIUM', 'REGULAR')
UNION ALL
SELECT 'domain(payment_status)', 'payments', CAST(payment_id AS VARCHAR), 'payment_status=' || payment_status
FROM payments WHERE payment_status NOT IN ('PENDING', 'SUCCESS', 'FAILED')""")

ORACLE["double_booked_seats"] = q("""
SELECT l.seat_id, s.show_id, l.booking_id, c.n AS n_bookings
FROM (SELECT DISTINCT bs.seat_id, bs.booking_id FROM booking_seats bs
      JOIN bookings b ON b.booking_id = bs.booking_id AND b.booking_status = 'CONFIRMED') l
JOIN (SELECT seat_id, count(*) AS n FROM (SELECT DISTINCT bs.seat_id, bs.booking_id FROM booking_seats bs
      JOIN bookings b ON b.booking_id = bs.booking_id AND b.booking_status = 'CONFIRMED') GROUP BY seat_id
      HAVING count(*) > 1) c ON c.seat_id = l.seat_id
LEFT JOIN seats s ON s.seat_id = l.seat_id""")

ORACLE["cost_drift"] = q("""
SELECT b.booking_id, CAST(b.total_amount AS DECIMAL(18,2)) AS stored_total,
       CAST(coalesce(st.s, 0) + coalesce(ft.f, 0) AS DECIMAL(18,2)) AS total_cost
FROM bookings b
LEFT JOIN (SELECT booking_id, sum(price) AS s FROM seat_lines_ GROUP BY 1) st ON st.booking_id = b.booking_id
LEFT JOIN (SELECT bf.booking_id, sum(f.price * bf.quantity) AS f FROM booking_food bf
           JOIN food_items f ON f.food_id = bf.food_id GROUP BY 1) ft ON ft.booking_id = b.booking_id
WHERE CAST(b.total_amount AS DECIMAL(18,2)) <> CAST(coalesce(st.s, 0) + coalesce(ft.f, 0) AS DECIMAL(18,2))""",
                         _SEAT_LINES)

ORACLE["rating_drift"] = q("""
SELECT s.show_id, s.avg_rating AS stored_rating,
       CAST(coalesce(CAST((200 * a.s + a.n) // (2 * a.n) AS DECIMAL(18,0)) * 0.01, 0) AS DECIMAL(3,2)) AS live_rating
FROM shows s LEFT JOIN (SELECT show_id, sum(rating) AS s, count(*) AS n FROM reviews
                        WHERE review_id NOT IN (SELECT review_id FROM gone_) GROUP BY 1) a USING (show_id)
WHERE s.avg_rating <> CAST(coalesce(CAST((200 * a.s + a.n) // (2 * a.n) AS DECIMAL(18,0)) * 0.01, 0) AS DECIMAL(3,2))""",
                           _DEL_REV)

ORACLE["availability_drift"] = q("""
SELECT seat_id, show_id, stored_available, expected_available FROM (
  SELECT s.seat_id, s.show_id,
         CASE WHEN s.is_available = 0 AND s.seat_id IN (
                SELECT bs.seat_id FROM booking_seats bs WHERE bs.booking_id IN
                  (SELECT booking_id FROM po_ WHERE outcome = 'APPLIED' AND payment_status = 'FAILED'))
              THEN 1 ELSE s.is_available END AS stored_available,
         CASE WHEN s.seat_id IN (SELECT bs.seat_id FROM booking_seats bs JOIN nb_ USING (booking_id)
                                 WHERE nb_.st <> 'CANCELLED') THEN 0 ELSE 1 END AS expected_available
  FROM seats s) WHERE stored_available <> expected_available""", _PAY + """,
nb_ AS (SELECT b.booking_id, CASE WHEN la.booking_id IS NULL THEN b.booking_status
                                  WHEN la.payment_status = 'SUCCESS' THEN 'CONFIRMED' ELSE 'CANCELLED' END AS st
        FROM bookings b LEFT JOIN la_ la USING (booking_id))
""")

ORACLE["validate_requests"] = q(r"""
SELECT 'booking' AS kind, b.booking_id AS request_id, b.show_id >= 1 AS valid,
       CASE WHEN b.show_id >= 1 THEN '' ELSE 'event_id must be a positive integer' END AS errors
FROM bookings b WHERE b.booking_id IN (SELECT l_orderkey FROM lineitem)
UNION ALL
SELECT 'review', b.booking_id * 10 + c.c,
       b.show_id >= 1 AND NOT (b.booking_id % 33 = 0),
       concat_ws('; ', CASE WHEN b.show_id < 1 THEN 'event_id is required' END,
                       CASE WHEN b.booking_id % 33 = 0 THEN 'Rating must be 1–5' END)
FROM bookings b, range(1, 3) c(c) WHERE c.c = 1 OR b.booking_id % 15 = 0
UNION ALL
SELECT 'register', c_custkey, c_custkey % 97 <> 0 AND c_custkey % 89 <> 0,
       concat_ws('; ', CASE WHEN c_custkey % 97 = 0 THEN 'Name is required' END,
                       CASE WHEN c_custkey % 89 = 0 THEN 'Password must be at least 6 characters' END)
FROM customer
UNION ALL
SELECT 'payment', b.booking_id * 10 + 5 + c.c, NOT (c.c = 1 AND (b.booking_id % 5 <> 0 OR b.booking_id % 45 = 0)),
       CASE WHEN c.c = 1 AND (b.booking_id % 5 <> 0 OR b.booking_id % 45 = 0) THEN 'payment_status must be SUCCESS or FAILED' ELSE '' END
FROM bookings b, range(1, 3) c(c) WHERE c.c = 1 OR b.booking_id % 25 = 0
UNION ALL
SELECT 'show', p_partkey * 10 + 9, p_partkey % 300 <> 0,
       CASE WHEN p_partkey % 300 = 0 THEN 'base_price required' ELSE '' END
FROM part
UNION ALL
SELECT 'food', s_suppkey * 10 + 1, s_suppkey % 30 <> 0,
       CASE WHEN s_suppkey % 30 = 0 THEN 'food_name and price are required' ELSE '' END
FROM supplier""")

ORACLE["paged"] = q("""
SELECT b.booking_id, b.user_id, u.full_name, u.email, b.show_id, e.title, b.booking_date, b.total_amount,
       b.booking_status, p.payment_status, p.payment_method
FROM bookings b JOIN users u ON u.user_id = b.user_id JOIN shows e ON e.show_id = b.show_id
LEFT JOIN payments p ON p.booking_id = b.booking_id
ORDER BY b.booking_date DESC, b.booking_id DESC LIMIT 20 OFFSET 40""")

ORACLE["paged_directory"] = q("""
SELECT * EXCLUDE (place) REPLACE (CAST((place - 1) // 20 + 1 AS INTEGER) AS page) FROM (
  SELECT b.booking_id, b.user_id, u.full_name, u.email, b.show_id, e.title, b.booking_date, b.total_amount,
         b.booking_status, p.payment_status, p.payment_method, 0 AS page, row_number() OVER (ORDER BY b.booking_date DESC, b.booking_id DESC) AS place
  FROM bookings b JOIN users u ON u.user_id = b.user_id JOIN shows e ON e.show_id = b.show_id
  LEFT JOIN payments p ON p.booking_id = b.booking_id) WHERE (place - 1) // 20 + 1 IN (1, 7, 60)""")

ORACLE["doc_sink"] = q("""
SELECT b.user_id, count(*) AS count FROM bookings b JOIN shows e ON e.show_id = b.show_id
JOIN venues v ON v.venue_id = e.venue_id GROUP BY b.user_id""")

ORACLE["outbox_sink"] = q(f"""
SELECT template, count(*) AS messages FROM (
  SELECT 'welcome' AS template FROM users
  UNION ALL
  SELECT 'reminder' FROM bookings b JOIN shows e ON b.show_id = e.show_id
  WHERE b.booking_status = 'CONFIRMED' AND e.show_date = {_AS_OF} + 1 AND coalesce(b.reminder_sent, 0) = 0
    AND b.booking_id IN (SELECT booking_id FROM booking_seats)
  UNION ALL
  SELECT 'cancellation' FROM bookings b JOIN users u ON b.user_id = u.user_id JOIN shows e ON b.show_id = e.show_id
  WHERE b.booking_status = 'CANCELLED') GROUP BY template""")

# --------------------------------------------------------------------------
# streams (final answers after availableNow)
# --------------------------------------------------------------------------
ORACLE["stream_avg_rating"] = q("""
SELECT show_id, CAST(CAST((200 * sum(rating) + count(*)) // (2 * count(*)) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(3,2))
         AS avg_rating, count(*) AS review_count
FROM reviews GROUP BY show_id""")

ORACLE["stream_request_windows"] = """
WITH ev AS (SELECT user_id, ts, 'api' AS scope FROM events
            UNION ALL SELECT user_id, ts, 'auth' FROM events WHERE event_type = 'signup'),
w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, user_id, scope, count(*) AS requests
      FROM ev GROUP BY ALL)
SELECT window_start, window_start + INTERVAL 15 MINUTE AS window_end, user_id, scope, requests,
       CASE WHEN scope = 'auth' THEN 100 ELSE 5000 END AS request_limit,
       requests > CASE WHEN scope = 'auth' THEN 100 ELSE 5000 END AS over_limit
FROM w"""

ORACLE["stream_reminders"] = q(f"""
SELECT DISTINCT b.booking_id, u.user_id, u.email, e.show_id, TIMESTAMP '1995-03-01 00:00:00' AS sent_as_of
FROM bookings b JOIN users u ON b.user_id = u.user_id JOIN shows e ON b.show_id = e.show_id
JOIN venues v ON e.venue_id = v.venue_id JOIN booking_seats bs ON b.booking_id = bs.booking_id
WHERE b.booking_status = 'CONFIRMED' AND e.show_date = {_AS_OF} + 1 AND coalesce(b.reminder_sent, 0) = 0""")

ORACLE["stream_revenue"] = q("""
SELECT show_id, CAST(sum(total_amount) AS DECIMAL(18,2)) AS revenue, count(*) AS bookings
FROM bookings WHERE booking_status = 'CONFIRMED' GROUP BY show_id""")

ORACLE["sql_functions"] = q("""
SELECT 'fn_total_booking_cost' AS routine, b.booking_id AS id, CAST(coalesce(sl.s, 0) + coalesce(fl.f, 0) AS DECIMAL(18,2)) AS value
FROM bookings b LEFT JOIN (SELECT booking_id, sum(price) AS s FROM seat_lines_ GROUP BY 1) sl ON sl.booking_id = b.booking_id
LEFT JOIN (SELECT bf.booking_id, sum(f.price * bf.quantity) AS f FROM booking_food bf JOIN food_items f ON f.food_id = bf.food_id GROUP BY 1) fl ON fl.booking_id = b.booking_id
UNION ALL SELECT 'fn_get_event_rating', e.show_id, CAST(coalesce(r.a, 0) AS DECIMAL(18,2))
FROM shows e LEFT JOIN (SELECT show_id, CAST((200 * sum(rating) + count(*)) // (2 * count(*)) AS DECIMAL(18,0)) * 0.01 AS a FROM reviews GROUP BY 1) r ON r.show_id = e.show_id
UNION ALL SELECT 'fn_is_seat_available', q.seat_id, CAST(coalesce(s.is_available, 0) AS DECIMAL(18,2)) FROM req_seats_ q LEFT JOIN seats s ON s.seat_id = q.seat_id""",
    _SEAT_LINES.rstrip() + "," + _REQ_SEATS)

ORACLE["show_search_batch"] = """
WITH p AS (SELECT p_partkey AS pattern_id, CASE WHEN p_partkey % 500 = 4 THEN '' WHEN p_partkey % 10 = 0 THEN upper(substr(p_name, 1 + p_partkey % 7, 2))
                  WHEN p_partkey % 10 = 1 THEN substr(p_name, 1 + p_partkey % 7, 2) || '_' || substr(p_name, 4 + p_partkey % 7, 2)
                  WHEN p_partkey % 10 = 2 THEN substr(p_name, 1, 3) || '%' || substr(p_name, 5 + p_partkey % 7, 3)
                  WHEN p_partkey % 10 = 3 THEN reverse(p_name) ELSE substr(p_name, 1 + p_partkey % 7, 3 + p_partkey % 6) END AS pattern FROM part)
SELECT pattern_id, e.p_partkey AS show_id, e.p_name AS title FROM p JOIN part e ON e.p_name ILIKE '%' || pattern || '%' WHERE pattern <> ''"""

ORACLE["stream_revenue_changes"] = q("""
SELECT show_id, CAST(sum(total_amount) AS DECIMAL(18,2)) AS revenue, count(*) AS bookings
FROM (SELECT booking_id, max_by(st, struct_pack(t := t, id := id)) AS st FROM chg_ GROUP BY booking_id) JOIN bookings USING (booking_id)
WHERE st = 'CONFIRMED' GROUP BY show_id""", _CANCEL.rstrip() + "," + _PAY.rstrip() + """,
chg_ AS (SELECT booking_id, booking_status AS st, booking_date AS t, booking_id * 10 AS id FROM bookings
         UNION ALL SELECT j.booking_id, 'CANCELLED', j.requested_at, j.request_id FROM cj_ j JOIN cf_ f USING (request_id) WHERE f.first AND j.st <> 'CANCELLED'
         UNION ALL SELECT booking_id, CASE WHEN payment_status = 'SUCCESS' THEN 'CONFIRMED' ELSE 'CANCELLED' END, requested_at, request_id FROM po_ WHERE outcome = 'APPLIED')
""")

ORACLE["stream_client_windows"] = """
WITH RECURSIVE ev AS (SELECT user_id, ts, 'api' AS scope FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
            UNION ALL SELECT user_id, ts, 'auth' FROM events WHERE event_type = 'signup' AND user_id IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT user_id, scope, min(ts) AS s FROM ev GROUP BY ALL
      UNION ALL SELECT w.user_id, w.scope, min(ev.ts) FROM w JOIN ev ON ev.user_id = w.user_id AND ev.scope = w.scope AND ev.ts >= w.s + INTERVAL 15 MINUTE
      GROUP BY w.user_id, w.scope, w.s)
SELECT w.user_id, w.scope, w.s AS window_start, w.s + INTERVAL 15 MINUTE AS window_end, count(*) AS requests,
       CASE WHEN w.scope = 'auth' THEN 100 ELSE 5000 END AS request_limit,
       count(*) > CASE WHEN w.scope = 'auth' THEN 100 ELSE 5000 END AS over_limit
FROM w JOIN ev ON ev.user_id = w.user_id AND ev.scope = w.scope AND ev.ts >= w.s AND ev.ts < w.s + INTERVAL 15 MINUTE
GROUP BY w.user_id, w.scope, w.s"""

_CONFIRMATION = f"""
SELECT u.email AS "to", 'Booking Confirmed – ' || e.title AS subject,
       '{_WRAP_A}' || '<h2>Booking #' || b.booking_id || ' Confirmed</h2><p>Seats: ' || coalesce(sl.txt, '')
         || '</p><p>Total: ₹' || CAST(b.total_amount AS VARCHAR) || '</p>' || '{_WRAP_B}' AS html,
       'confirmation' AS template, 'confirmation:' || b.booking_id AS message_id
FROM bookings b JOIN users u ON b.user_id = u.user_id JOIN shows e ON b.show_id = e.show_id
LEFT JOIN (SELECT booking_id, string_agg(row_letter || seat_number || '(' || seat_type || ')', ', '
                                         ORDER BY row_letter, seat_number, seat_type) AS txt
           FROM seat_lines_ GROUP BY 1) sl ON sl.booking_id = b.booking_id
WHERE b.booking_status = 'CONFIRMED'"""
ORACLE["outbox_confirmation"] = q(_CONFIRMATION, _SEAT_LINES)

ORACLE["outbox_bulk"] = q(f"""
SELECT u.email AS "to", m.subject, '{_WRAP_A}' || '<h3>' || m.subject || '</h3><p>' || m.message || '</p><p>– Team Box Office</p>' || '{_WRAP_B}' AS html,
       'bulk' AS template, 'bulk:' || substr(sha256(m.subject || chr(10) || m.message), 1, 16) || ':' || u.user_id AS message_id
FROM users u, (VALUES ('New season', 'Booking opens on Friday.'), ('Summer offers', 'Two for one in June.')) m(subject, message)""")

ORACLE["stream_outbox"] = q(f"""
SELECT u.email AS "to", 'Booking Confirmed – ' || e.title AS subject,
       '{_WRAP_A}' || '<h2>Booking #' || b.booking_id || ' Confirmed</h2><p>Seats: ' || coalesce(sl.txt, '')
         || '</p><p>Total: ₹' || CAST(b.total_amount AS VARCHAR) || '</p>' || '{_WRAP_B}' AS html,
       'confirmation' AS template, 'confirmation:' || b.booking_id AS message_id
FROM bookings b JOIN users u ON b.user_id = u.user_id JOIN shows e ON b.show_id = e.show_id
LEFT JOIN (SELECT booking_id, string_agg(row_letter || seat_number || '(' || seat_type || ')', ', '
                                         ORDER BY row_letter, seat_number, seat_type) AS txt
           FROM seat_lines_ GROUP BY 1) sl ON sl.booking_id = b.booking_id
WHERE b.booking_status = 'CONFIRMED'
UNION ALL
SELECT u.email, 'Booking Cancelled – ' || e.title,
       '{_WRAP_A}' || '<h2>Booking #' || b.booking_id || ' Cancelled</h2>' || '{_WRAP_B}', 'cancellation',
       'cancellation:' || b.booking_id
FROM bookings b JOIN users u ON b.user_id = u.user_id JOIN shows e ON b.show_id = e.show_id
WHERE b.booking_status = 'CANCELLED'""", _SEAT_LINES)

ORACLE["booking_detail"] = q("""
SELECT b.booking_id, b.user_id, b.show_id, e.title, v.venue_name, b.booking_status, p.payment_status,
       CAST(coalesce(sl.n, 0) AS INTEGER) AS n_seats, CAST(coalesce(fl.n, 0) AS INTEGER) AS n_food
FROM bookings b JOIN shows e ON e.show_id = b.show_id JOIN venues v ON v.venue_id = e.venue_id
LEFT JOIN payments p ON p.booking_id = b.booking_id
LEFT JOIN (SELECT booking_id, count(*) AS n FROM seat_lines_ GROUP BY 1) sl ON sl.booking_id = b.booking_id
LEFT JOIN (SELECT bf.booking_id, count(*) AS n FROM booking_food bf JOIN food_items f ON f.food_id = bf.food_id
           GROUP BY 1) fl ON fl.booking_id = b.booking_id
WHERE true""", _SEAT_LINES)

ORACLE["stream_rating_upkeep"] = q("""
SELECT show_id,
       CAST(CAST((200 * sum(rating) + count(*)) // (2 * count(*)) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(3,2)) AS avg_rating,
       count(*) AS review_count
FROM (SELECT v.show_id, coalesce(l.rating, v.rating) AS rating
      FROM reviews v LEFT JOIN ul_ l ON l.review_id = v.review_id
      WHERE v.review_id NOT IN (SELECT review_id FROM gone_))
GROUP BY show_id""", """
ur_ AS (
  SELECT review_id * 10 + 2 AS request_id, reviewed_at + INTERVAL 1 DAY AS requested_at,
         CASE WHEN review_id % 20 = 0 THEN -review_id - 1 ELSE review_id END AS review_id,
         CASE WHEN review_id % 4 = 1 THEN NULL WHEN review_id % 8 = 4 THEN user_id ELSE user_id + 1 END AS actor_id,
         CAST(CASE WHEN review_id % 12 = 0 THEN 0 ELSE rating % 5 + 1 END AS INTEGER) AS rating
  FROM reviews),
uo_ AS (
  SELECT r.*, CASE WHEN NOT (r.rating BETWEEN 1 AND 5) THEN 'INVALID' WHEN v.review_id IS NULL THEN 'NOT_FOUND'
                   WHEN v.user_id = r.actor_id THEN 'UPDATED' ELSE 'FORBIDDEN' END AS outcome
  FROM ur_ r LEFT JOIN reviews v USING (review_id)),
ul_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY requested_at DESC, request_id DESC) AS rn
                       FROM uo_ WHERE outcome = 'UPDATED') WHERE rn = 1),
""" + _DEL_REV.strip())

ORACLE["stream_hold_expiry"] = """
SELECT h.event_id AS hold_id, h.user_id, h.ts AS hold_ts FROM events h
WHERE h.event_type = 'view' AND NOT EXISTS (
  SELECT 1 FROM events c WHERE c.event_type = 'purchase' AND c.user_id = h.user_id AND c.ts >= h.ts AND c.ts <= h.ts + INTERVAL 5 MINUTE)"""

# --------------------------------------------------------------------------
# Ordered replay of book, cancel and payment commands per show.  The
# recursion carries each show's ledger: unavailable seats and a list of bookings.
# --------------------------------------------------------------------------
_REPLAY = _ALLOC.split("od_ AS")[0].rstrip().rstrip(",") + """,
cr_ AS (
  SELECT booking_id * 10 + 3 AS request_id, booking_date + INTERVAL 2 DAY AS requested_at,
         CASE WHEN booking_id % 49 = 0 THEN -booking_id - 1 ELSE booking_id END AS booking_id,
         CASE WHEN booking_id % 7 <> 0 OR booking_id % 21 = 0 THEN user_id + 1 ELSE user_id END AS actor_id
  FROM bookings),
pr_ AS (
  SELECT b.booking_id * 10 + 5 + c.c AS request_id, b.booking_date + to_hours(c.c) AS requested_at, b.booking_id,
         CASE WHEN b.booking_id % 65 = 0 THEN NULL WHEN b.booking_id % 35 = 0 THEN b.user_id + 1 ELSE b.user_id END AS actor_id,
         CASE WHEN c.c = 2 THEN 'SUCCESS' WHEN b.booking_id % 5 <> 0 OR b.booking_id % 45 = 0 THEN 'REFUNDED'
              WHEN b.booking_id % 10 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS payment_status
  FROM bookings b, range(1, 3) c(c) WHERE c.c = 1 OR b.booking_id % 25 = 0),
cmd_ AS (
  SELECT show_id, requested_at AS ts, request_id AS cmd_id, 'book' AS kind, request_id AS booking_id,
         user_id AS actor_id, false AS adm, seats, seat_ok, food_ok, CAST(NULL AS VARCHAR) AS pstatus
  FROM ck_
  UNION ALL
  SELECT k.show_id, r.requested_at, r.request_id, 'cancel', r.booking_id, r.actor_id, r.actor_id % 100 = 0,
         CAST(NULL AS BIGINT[]), NULL, NULL, NULL
  FROM cr_ r LEFT JOIN ck_ k ON k.request_id = r.booking_id
  UNION ALL
  SELECT k.show_id, r.requested_at, r.request_id, 'payment', r.booking_id, r.actor_id, r.actor_id % 100 = 0,
         CAST(NULL AS BIGINT[]), NULL, NULL, r.payment_status
  FROM pr_ r LEFT JOIN ck_ k ON k.request_id = r.booking_id),
oc_ AS (SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY ts, cmd_id) AS rn FROM cmd_ WHERE show_id IS NOT NULL),
rp_ AS (
  SELECT show_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS taken,
         CAST([] AS STRUCT(id BIGINT, owner BIGINT, status VARCHAR, seats BIGINT[], paid BOOLEAN)[]) AS bk,
         CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS cmd_id, CAST(NULL AS VARCHAR) AS kind,
         CAST(NULL AS BIGINT) AS booking_id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS status_after,
         CAST(NULL AS VARCHAR) AS unavail
  FROM (SELECT DISTINCT show_id FROM oc_)
  UNION ALL
  SELECT show_id, rn,
         CASE WHEN outcome = 'ACCEPTED' THEN list_concat(taken, seats)
              WHEN outcome = 'CANCELLED' OR (outcome = 'APPLIED' AND pstatus = 'FAILED')
                THEN list_filter(taken, lambda x: NOT list_contains(b.seats, x))
              ELSE taken END,
         CASE WHEN outcome = 'ACCEPTED'
                THEN list_append(bk, {'id': booking_id, 'owner': actor_id, 'status': 'CONFIRMED', 'seats': seats,
                                      'paid': true})
              WHEN outcome IN ('CANCELLED', 'APPLIED')
                THEN list_transform(bk, lambda x: CASE WHEN x.id = booking_id
                       THEN {'id': x.id, 'owner': x.owner, 'status': status_after,
                             'seats': CASE WHEN outcome = 'CANCELLED' THEN CAST([] AS BIGINT[]) ELSE x.seats END,
                             'paid': outcome <> 'CANCELLED'}
                       ELSE x END)
              ELSE bk END,
         ts, cmd_id, kind, booking_id, outcome, status_after, unavail
  FROM (
    SELECT s.*,
           CASE WHEN s.outcome = 'ACCEPTED' THEN 'CONFIRMED' WHEN s.outcome = 'CANCELLED' THEN 'CANCELLED'
                WHEN s.outcome = 'APPLIED' THEN CASE WHEN s.pstatus = 'SUCCESS' THEN 'CONFIRMED' ELSE 'CANCELLED' END
                WHEN s.kind = 'book' THEN NULL ELSE s.b.status END AS status_after
    FROM (
      SELECT o.show_id, o.rn, r.taken, r.bk, o.ts, o.cmd_id, o.kind, o.booking_id, o.actor_id, o.seats, o.pstatus,
             b,
             CASE WHEN o.kind = 'book' THEN
                    CASE WHEN NOT o.seat_ok THEN 'INVALID_SEAT' WHEN list_has_any(r.taken, o.seats) THEN 'CONFLICT'
                         WHEN NOT o.food_ok THEN 'INVALID_FOOD' ELSE 'ACCEPTED' END
                  WHEN o.kind = 'cancel' THEN
                    CASE WHEN b IS NULL THEN 'NOT_FOUND' WHEN NOT (coalesce(b.owner = o.actor_id, false) OR coalesce(o.adm, false)) THEN 'FORBIDDEN'
                         WHEN b.status = 'CANCELLED' THEN 'ALREADY_CANCELLED' ELSE 'CANCELLED' END
                  ELSE
                    CASE WHEN o.pstatus NOT IN ('SUCCESS', 'FAILED') THEN 'INVALID_STATUS'
                         WHEN b IS NULL OR NOT b.paid THEN 'NOT_FOUND'
                         WHEN NOT (coalesce(b.owner = o.actor_id, false) OR coalesce(o.adm, false)) THEN 'FORBIDDEN' ELSE 'APPLIED' END
             END AS outcome,
             CASE WHEN o.kind = 'book' AND o.seat_ok AND list_has_any(r.taken, o.seats)
                  THEN array_to_string(list_sort(list_distinct(list_filter(o.seats, lambda x: list_contains(r.taken, x)))), ',')
             END AS unavail
      FROM rp_ r JOIN oc_ o ON o.show_id = r.show_id AND o.rn = r.rn + 1
      LEFT JOIN LATERAL (SELECT list_filter(r.bk, lambda x: x.id = o.booking_id)[1] AS b) lb ON true) s) t)
"""
_REPLAY_SELECT = """
SELECT show_id, ts, cmd_id, kind, booking_id, outcome, status_after AS booking_status, unavail AS unavailable_seats
FROM rp_ WHERE cmd_id IS NOT NULL
"""
ORACLE["replay_booking_log"] = q(_REPLAY_SELECT + """
UNION ALL
SELECT CAST(NULL AS BIGINT), ts, cmd_id, kind, booking_id, 'NOT_FOUND', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
FROM cmd_ WHERE show_id IS NULL""", _REPLAY, recursive=True)
ORACLE["stream_seat_state"] = q(_REPLAY_SELECT, _REPLAY, recursive=True)

# --------------------------------------------------------------------------
# the tables after the apply jobs: one row of text per row, NULL shown as ~
# --------------------------------------------------------------------------
def _rows(table: str, cols: list[str], source: str) -> str:
    text = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in cols)
    return f"SELECT '{table}' AS table_name, {text} AS row_text FROM {source}"


_BOOKING = ["booking_id", "user_id", "show_id", "booking_date", "total_amount", "booking_status", "reminder_sent"]
_BS, _BF = ["bs_id", "booking_id", "seat_id"], ["bf_id", "booking_id", "food_id", "quantity"]
_PAYMENT = ["payment_id", "booking_id", "amount", "payment_method", "payment_status", "paid_at"]
_REVIEW = ["review_id", "user_id", "show_id", "rating", "comment", "reviewed_at"]
_USER = ["user_id", "full_name", "email", "password_hash", "is_admin", "created_at"]
_SHOW = ["show_id", "title", "description", "show_date", "show_time", "venue_id", "category_id", "base_price", "avg_rating"]
_FOOD = ["food_id", "food_name", "price", "is_veg"]
_SOLD = ["seat_id"]


def _union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


_NEW_ALLOC = _ALLOC.rstrip() + """,
won_ AS (SELECT a.booking_id, c.*, CAST(c.seat_total + coalesce(c.food_total, 0) AS DECIMAL(10,2)) AS total
         FROM acc_ a JOIN ck_ c USING (request_id)),
nb_ AS (SELECT booking_id, user_id, show_id, requested_at AS booking_date, total AS total_amount,
               'CONFIRMED' AS booking_status, 0 AS reminder_sent FROM won_),
nl_ AS (SELECT row_number() OVER (ORDER BY booking_id, seat_id) AS bs_id, booking_id, seat_id
        FROM (SELECT booking_id, unnest(seats) AS seat_id FROM won_)),
nf_ AS (SELECT row_number() OVER (ORDER BY w.booking_id, r.l_linenumber, r.l_suppkey) AS bf_id, w.booking_id,
               r.l_suppkey AS food_id, r.l_linenumber AS quantity
        FROM won_ w JOIN rl_ r USING (request_id) WHERE r.l_returnflag = 'R'),
np2_ AS (SELECT row_number() OVER (ORDER BY w.booking_id) AS payment_id, w.booking_id, w.total AS amount,
               b.method_ AS payment_method, 'SUCCESS' AS payment_status, w.requested_at AS paid_at
        FROM won_ w JOIN bookings b ON b.booking_id = w.request_id)
"""
ORACLE["allocate_seats_state"] = q(_union(
    _rows("bookings", _BOOKING, "nb_"), _rows("booking_seats", _BS, "nl_"), _rows("booking_food", _BF, "nf_"),
    _rows("payments", _PAYMENT, "np2_"), _rows("sold_seats", _SOLD, "(SELECT DISTINCT seat_id FROM nl_)")), _NEW_ALLOC, recursive=True)

_NEW_QUICK = _QUICK.rstrip() + """,
won_ AS (SELECT a.booking_id, c.* FROM acc_ a JOIN qc_ c USING (request_id)),
nb_ AS (SELECT booking_id, user_id, show_id, booking_date, total_amount, booking_status, reminder_sent FROM bookings
        UNION ALL SELECT booking_id, user_id, show_id, requested_at, CAST(seat_total AS DECIMAL(10,2)), 'CONFIRMED', 0 FROM won_),
nl_ AS (SELECT bs_id, booking_id, seat_id FROM booking_seats
        UNION ALL SELECT (SELECT max(bs_id) FROM booking_seats) + row_number() OVER (ORDER BY booking_id, seat_id), booking_id, seat_id
        FROM (SELECT booking_id, unnest(seats) AS seat_id FROM won_)),
nf_ AS (SELECT bf_id, booking_id, food_id, quantity FROM booking_food
        UNION ALL SELECT (SELECT max(bf_id) FROM booking_food) + row_number() OVER (ORDER BY booking_id), booking_id, food_id, qty
        FROM won_ WHERE food_id > 0 AND qty > 0),
np2_ AS (SELECT payment_id, booking_id, amount, payment_method, payment_status, paid_at FROM payments
        UNION ALL SELECT (SELECT max(payment_id) FROM payments) + row_number() OVER (ORDER BY booking_id), booking_id,
               CAST(seat_total AS DECIMAL(10,2)), 'UPI', 'PENDING', NULL FROM won_),
ns_ AS (SELECT seat_id FROM seats WHERE is_available = 0 UNION SELECT unnest(seats) FROM won_)
"""
ORACLE["quick_book_two_state"] = q(_union(
    _rows("bookings", _BOOKING, "nb_"), _rows("booking_seats", _BS, "nl_"), _rows("booking_food", _BF, "nf_"),
    _rows("payments", _PAYMENT, "np2_"), _rows("sold_seats", _SOLD, "ns_")), _NEW_QUICK, recursive=True)


def _after(name: str) -> tuple[str, str]:
    """The outcome statement of a job as a CTE body, and the CTEs that it rests on."""
    body = ORACLE[name]
    head = mapping_cte()
    rest = body[len(head.rstrip()):].lstrip()
    if rest.startswith(","):  # further CTEs up to the statement at the left margin
        cut = rest.index("\n)\nSELECT") + 2 if "\n)\nSELECT" in rest else rest.index(")\nSELECT") + 1
        return rest[cut:].strip(), rest[1:cut].strip() + ",\n"
    return rest.strip(), ""


def _state(name: str, tables: str, *parts: str) -> str:
    select, ctes = _after(name)
    return q(_union(*parts), f"{ctes}oc_ AS (\n{select}),\n{tables.strip()}")


ORACLE["register_users_state"] = _state("register_users", """
nu_ AS (SELECT user_id, full_name, email, password_hash, is_admin, created_at FROM users
        UNION ALL SELECT o.user_id, r.full_name, r.email, '', false, r.requested_at
        FROM oc_ o JOIN rr_ r USING (request_id) WHERE o.outcome = 'ACCEPTED')""", _rows("users", _USER, "nu_"))
ORACLE["cancel_bookings_state"] = _state("cancel_bookings", """
dn_ AS (SELECT DISTINCT booking_id FROM oc_ WHERE outcome = 'CANCELLED'),
nb_ AS (SELECT * REPLACE (CASE WHEN booking_id IN (SELECT booking_id FROM dn_) THEN 'CANCELLED' ELSE booking_status END
                          AS booking_status) FROM bookings),
ns_ AS (SELECT seat_id FROM seats WHERE is_available = 0 AND seat_id NOT IN
        (SELECT seat_id FROM booking_seats WHERE booking_id IN (SELECT booking_id FROM dn_)))""",
    _rows("bookings", _BOOKING, "nb_"), *[_rows(t, c, f"{t} WHERE booking_id NOT IN (SELECT booking_id FROM dn_)")
                                          for t, c in (("booking_seats", _BS), ("booking_food", _BF), ("payments", _PAYMENT))],
    _rows("sold_seats", _SOLD, "ns_"))
ORACLE["state_versions"] = ORACLE["cancel_bookings_state"]
_RATED = """
ra_ AS (SELECT show_id, sum(rating) AS s, count(*) AS n FROM nr_ GROUP BY 1),
sh_ AS (SELECT s.* REPLACE (CAST(coalesce(CAST((200 * a.s + a.n) // (2 * a.n) AS DECIMAL(18,0)) * 0.01, 0) AS DECIMAL(3,2)) AS avg_rating)
        FROM shows s LEFT JOIN ra_ a USING (show_id))"""
ORACLE["submit_reviews_state"] = _state("submit_reviews", """
nr_ AS (SELECT review_id, user_id, show_id, rating, comment, reviewed_at FROM reviews
        UNION ALL SELECT o.review_id, o.user_id, o.show_id, r.rating,
               CASE WHEN (r.request_id // 10) % 2 = 0 THEN NULL ELSE 'Request ' || (r.request_id // 10) END, r.requested_at
        FROM oc_ o JOIN vr_ r USING (request_id) WHERE o.outcome = 'ACCEPTED'),""" + _RATED,
    _rows("reviews", _REVIEW, "nr_"), _rows("shows", _SHOW, "sh_"))
ORACLE["update_reviews_state"] = _state("update_reviews", """
nr_ AS (SELECT v.review_id, v.user_id, v.show_id, CASE WHEN l.review_id IS NULL THEN v.rating ELSE l.rating END AS rating,
               CASE WHEN l.review_id IS NULL THEN v.comment ELSE l.comment END AS comment, v.reviewed_at
        FROM reviews v LEFT JOIN ul_ l USING (review_id)),""" + _RATED,
    _rows("reviews", _REVIEW, "nr_"), _rows("shows", _SHOW, "sh_"))
ORACLE["delete_reviews_state"] = _state("delete_reviews", """
nr_ AS (SELECT review_id, user_id, show_id, rating, comment, reviewed_at FROM reviews
        WHERE review_id NOT IN (SELECT review_id FROM gone_)),""" + _RATED,
    _rows("reviews", _REVIEW, "nr_"), _rows("shows", _SHOW, "sh_"))
ORACLE["create_shows_state"] = _state("create_shows", """
nw_ AS (SELECT show_id, title, description, show_date, show_time, venue_id, category_id, base_price, avg_rating FROM shows
        UNION ALL SELECT o.show_id, o.title, NULL, DATE '2002-01-01' + CAST(p_partkey % 365 AS INTEGER), '19:00:00',
               CAST(p_size % 25 AS BIGINT), CAST(1 + p_partkey % 3 AS BIGINT), CAST(p_retailprice AS DECIMAL(10,2)), CAST(0 AS DECIMAL(3,2))
        FROM oc_ o JOIN part ON p_partkey * 10 + 9 = o.request_id WHERE o.outcome = 'CREATED')""", _rows("shows", _SHOW, "nw_"))
ORACLE["add_food_items_state"] = _state("add_food_items", """
nw_ AS (SELECT food_id, food_name, price, is_veg FROM food_items
        UNION ALL SELECT o.food_id, o.food_name, CAST((5 + s_suppkey % 7) * 10 AS DECIMAL(8,2)),
               CASE WHEN s_suppkey % 20 = 0 THEN 1 ELSE CAST(s_suppkey % 40 <> 0 AS INTEGER) END
        FROM oc_ o JOIN supplier ON s_suppkey * 10 + 1 = o.request_id WHERE o.outcome = 'CREATED')""", _rows("food_items", _FOOD, "nw_"))
ORACLE["audit_unique_after_seat_map"] = """
SELECT CAST(NULL AS VARCHAR) AS rule, CAST(NULL AS VARCHAR) AS table_name, CAST(NULL AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS detail
WHERE false"""

_LOOKUP = {"bookings": "booking_id IN (SELECT booking_id FROM payments)", "seats": "seat_id IN (SELECT seat_id FROM booking_seats)",
           "payments": "booking_id IN (SELECT booking_id FROM bookings)", "reviews": "review_id IN (SELECT booking_id FROM bookings)",
           "users": "user_id IN (SELECT user_id FROM bookings)"}
for _table, _where in _LOOKUP.items():
    _drop = {"bookings": " EXCLUDE (method_, prio_)", "users": " EXCLUDE (password_hash)"}.get(_table, "")
    ORACLE[f"point_lookup_{_table}"] = q(f"SELECT *{_drop} FROM {_table} WHERE {_where}")
ORACLE["categories_list"] = q("SELECT * FROM categories")
ORACLE["venues_list"] = q("SELECT * FROM venues")

ORACLE["replay_final_state"] = q("""
SELECT 'bookings' AS table_name, booking_id || '|' || show_id || '|' || status_after AS row_text FROM (
  SELECT booking_id, show_id, status_after, row_number() OVER (PARTITION BY booking_id ORDER BY ts DESC, cmd_id DESC) AS n
  FROM rp_ WHERE status_after IS NOT NULL) WHERE n = 1
UNION ALL
SELECT 'payments', booking_id || '|' || st || '|' || coalesce(m, 'UPI') || '|' || coalesce(CAST(CASE WHEN st = 'SUCCESS' THEN ts END AS VARCHAR), '~')
FROM (SELECT booking_id, first(CASE WHEN kind = 'book' THEN 'SUCCESS' ELSE pstatus END ORDER BY ts DESC, cmd_id DESC) AS st,
             first(ts ORDER BY ts DESC, cmd_id DESC) AS ts, bool_or(kind = 'cancel') AS gone,
             first(pm ORDER BY ts DESC, cmd_id DESC) FILTER (pm IS NOT NULL) AS m
      FROM (SELECT r.*, c.pstatus, CASE WHEN r.kind = 'book' THEN CASE WHEN k.prio_ = '5' THEN NULL ELSE k.method_ END
                                        WHEN r.booking_id % 20 = 0 THEN NULL ELSE 'Credit Card' END AS pm
            FROM rp_ r JOIN oc_ c ON c.cmd_id = r.cmd_id AND c.kind = r.kind LEFT JOIN bookings k ON k.booking_id = r.booking_id
            WHERE r.outcome IN ('ACCEPTED', 'CANCELLED', 'APPLIED'))
      GROUP BY booking_id) WHERE NOT gone
UNION ALL
SELECT 'seats', seat_id || '|' || av FROM (
  SELECT seat_id, first(av ORDER BY ts DESC, cmd_id DESC) AS av FROM (
    SELECT e.ts, e.cmd_id, CASE WHEN e.outcome = 'ACCEPTED' THEN 0 ELSE 1 END AS av, unnest(k.seats) AS seat_id
    FROM rp_ e JOIN ck_ k ON k.request_id = e.booking_id
    WHERE e.outcome IN ('ACCEPTED', 'CANCELLED') OR (e.outcome = 'APPLIED' AND e.status_after = 'CANCELLED')) GROUP BY seat_id)
""", _REPLAY, recursive=True)

ORACLE["stream_seat_availability"] = q("""
SELECT show_id, seat_id, first(av ORDER BY ts DESC, cmd_id DESC) AS is_available FROM (
  SELECT e.show_id, e.ts, e.cmd_id, CASE WHEN e.outcome = 'ACCEPTED' THEN 0 ELSE 1 END AS av, unnest(k.seats) AS seat_id
  FROM rp_ e JOIN ck_ k ON k.request_id = e.booking_id
  WHERE e.outcome IN ('ACCEPTED', 'CANCELLED') OR (e.outcome = 'APPLIED' AND e.status_after = 'CANCELLED')) GROUP BY show_id, seat_id
""", _REPLAY, recursive=True)

ORACLE["stream_registration_outbox"] = q(f"""
SELECT email AS "to", 'Welcome to Box Office!' AS subject,
       '{_WRAP_A}<h2>Welcome, ' || full_name || '!</h2><p>Your account is ready.</p>{_WRAP_B}' AS html,
       'welcome' AS template, 'welcome:' || user_id AS message_id
FROM users""")

ORACLE["paged_after"] = q("""
SELECT b.booking_id, b.user_id, u.full_name, u.email, b.show_id, e.title, b.booking_date, b.total_amount,
       b.booking_status, p.payment_status, p.payment_method
FROM bookings b JOIN users u ON u.user_id = b.user_id JOIN shows e ON e.show_id = b.show_id
LEFT JOIN payments p ON p.booking_id = b.booking_id
WHERE b.booking_date < TIMESTAMP '1998-01-01 00:00:00' OR (b.booking_date = TIMESTAMP '1998-01-01 00:00:00' AND b.booking_id < 0)
ORDER BY b.booking_date DESC, b.booking_id DESC LIMIT 20""")
ORACLE["rating_summary"] = q("""
SELECT s.show_id, s.avg_rating, CAST(coalesce(t.t, 0) AS BIGINT) AS total_reviews, d.stars
FROM shows s LEFT JOIN (SELECT show_id, count(*) AS t FROM reviews GROUP BY 1) t ON t.show_id = s.show_id
JOIN (SELECT x.show_id, string_agg(coalesce(c.c, 0) || '=' || CAST(CASE WHEN t.t IS NULL THEN 0
               ELSE CAST((2000 * coalesce(c.c, 0) + t.t) // (2 * t.t) AS DECIMAL(18,0)) * 0.1 END AS DECIMAL(4,1)), ' ' ORDER BY g.r DESC) AS stars
      FROM shows x CROSS JOIN range(1, 6) g(r)
      LEFT JOIN (SELECT show_id, rating, count(*) AS c FROM reviews GROUP BY 1, 2) c ON c.show_id = x.show_id AND c.rating = g.r
      LEFT JOIN (SELECT show_id, count(*) AS t FROM reviews GROUP BY 1) t ON t.show_id = x.show_id GROUP BY x.show_id) d ON d.show_id = s.show_id""")
ORACLE["sql_views"] = q("""
SELECT e.title AS event_name, p.payment_status, count(*) AS bookings, max(r.rev) AS total_revenue
FROM bookings b JOIN users u ON b.user_id = u.user_id JOIN shows e ON b.show_id = e.show_id JOIN venues v ON e.venue_id = v.venue_id
LEFT JOIN payments p ON b.booking_id = p.booking_id
JOIN (SELECT s.show_id, s.title, CAST(coalesce(sum(k.total_amount), 0) AS DECIMAL(18,2)) AS rev FROM shows s
      LEFT JOIN bookings k ON k.show_id = s.show_id AND k.booking_status = 'CONFIRMED' GROUP BY s.show_id, s.title) r ON r.title = e.title
WHERE r.show_id IN (SELECT show_id FROM seats WHERE is_available = 1 AND seat_type = 'VIP')
GROUP BY e.title, p.payment_status""")
