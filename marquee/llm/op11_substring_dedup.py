"""Query op11_substring_dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.llm.common import read
from marquee.llm.substring_dedup import remove_repeats


def query(spark, sf_dir):
    """Words covered by a window of 13 words that also starts in a document with a smaller doc_id are removed."""
    return remove_repeats(read(spark, sf_dir, "documents"), 13).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
keyed AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM win),
firsts AS (SELECT k, min(doc_id) AS least FROM keyed GROUP BY k),
dup AS (SELECT r, i FROM keyed JOIN firsts USING (k) WHERE doc_id > least),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM dup),
lost AS (SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT words.r, string_agg(x, ' ' ORDER BY words.p) AS t FROM words ANTI JOIN gone ON words.r = gone.r AND words.p = gone.p GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""
