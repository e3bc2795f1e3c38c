"""Query op7_license_scan."""

from __future__ import annotations

from marquee.llm.common import read
from marquee.llm.license_scan import scan


def query(spark, sf_dir):
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    return scan(read(spark, sf_dir, "documents")).drop("spans")
