"""Query op10_suffix_dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.llm.common import read
from marquee.llm.suffix_dedup import remove_repeats


def query(spark, sf_dir):
    """Bytes covered by a 200-byte string that also starts anywhere else are removed."""
    return remove_repeats(read(spark, sf_dir, "documents"), 200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
