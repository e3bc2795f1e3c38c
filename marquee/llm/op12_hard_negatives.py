"""Query op12_hard_negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.llm.common import read
from marquee.llm.hard_negatives import hard_negatives


def query(spark, sf_dir):
    """For every anchor (vec_id divisible by 100) and each of its 5 positives the 5 hardest negatives."""
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), "vec_id % 100 = 0", positives=5, negatives=5, low=80, high=100, scale=256)


ORACLE = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id AS vec_id, a.label = x.label AS same,
             CAST(list_sum(list_transform(list_zip(a.e, x.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v x ON a.vec_id % 100 = 0 AND a.vec_id <> x.vec_id AND len(a.e) = len(x.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
