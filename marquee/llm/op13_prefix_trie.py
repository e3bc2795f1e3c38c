"""Query op13_prefix_trie."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.llm.common import read, written
from marquee.llm.prefix_trie import prefix_trie, shared_openings, turns_of


def query(spark, sf_dir):
    """The nodes of the trie of all conversations, each led by the opening of its hundred's first."""
    turns = written(turns_of(read(spark, sf_dir, "conversations")), "trie-placed")
    nodes = written(prefix_trie(shared_openings(turns)), "trie-result")
    up = nodes.select(F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"))
    return nodes.join(up, "parent", "left").select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), "ends_sha256")


ORACLE = """
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                      len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS t, len(coalesce(text, '')) AS n
               FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS UBIGINT))),
              lambda a, c: list_reduce(list_prepend(xor(a, c), [CAST(k AS UBIGINT) for k in range(8)]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS UBIGINT)) ELSE x // 2 END)) AS crc
          FROM (SELECT DISTINCT conv_id FROM turns)),
led AS (SELECT conv_id, base, CAST(xor(crc, CAST(4294967295 AS UBIGINT)) % 6 AS BIGINT) AS h FROM convs),
rebuilt AS (SELECT led.conv_id, 0 AS part, pos, t, n FROM led JOIN turns ON turns.conv_id = led.base AND pos < h
            UNION ALL SELECT led.conv_id, 1, pos, t, n FROM led JOIN turns ON turns.conv_id = led.conv_id AND pos >= h),
paths AS (SELECT led.conv_id, list(sha256(t) ORDER BY part, pos) FILTER (t IS NOT NULL) AS ts, list(n ORDER BY part, pos) FILTER (t IS NOT NULL) AS ns
          FROM led LEFT JOIN rebuilt USING (conv_id) GROUP BY 1),
steps AS (SELECT conv_id, coalesce(len(ts), 0) AS size, unnest(range(0, coalesce(len(ts), 0) + 1)) AS depth, ts, ns FROM paths),
members AS (SELECT conv_id, size, depth, sha256(array_to_string(ts[1:depth], ',')) AS key, CASE WHEN depth > 0 THEN sha256(array_to_string(ts[1:depth - 1], ',')) END AS parent,
                   coalesce(ns[depth], 0) AS n FROM steps),
nodes AS (SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM members GROUP BY key, depth),
kids AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
weighed AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
below AS (SELECT m.key, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((w.n_convs - 1) * w.n) AS saved_tokens
          FROM members m JOIN members d ON d.conv_id = m.conv_id AND d.depth >= m.depth JOIN weighed w ON w.key = d.key AND w.conv_id = d.conv_id GROUP BY m.key)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(w.n_convs AS BIGINT) AS n_convs, CAST(w.n_children AS BIGINT) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM weighed w JOIN below b USING (key) LEFT JOIN weighed p ON p.key = w.parent
"""
