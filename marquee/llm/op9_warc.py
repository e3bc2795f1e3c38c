"""Query op9_warc."""

from __future__ import annotations

from marquee.llm.common import read
from marquee.llm.warc import capture_histories


def query(spark, sf_dir):
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured: in order of URL key and time."""
    found = capture_histories(read(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


ORACLE = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS o FROM p),
k AS (SELECT *, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM g)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> o THEN o END AS refers_to,
       array_to_string(list_reverse(string_split(lower(regexp_extract(rest, '(?s)^([^/?#]*)', 1)), '.')), ',') || ')'
         || regexp_replace(rest, '(?s)^[^/?#]*', '') AS url_key,
       strftime(make_timestamp((1577836800 + page_id % 315360000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM k"""
