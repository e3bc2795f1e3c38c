"""Query op6_ngram_join."""

from __future__ import annotations

from marquee.llm.common import read
from marquee.llm.ngram_join import ngram_components


def query(spark, sf_dir):
    """doc_id, n_shingles, component_id: 4-word shingles, similarity 0.85 (85 / 100)."""
    return ngram_components(read(spark, sf_dir, "documents"), 4, 85, 100).select("doc_id", "n_shingles", "component_id")
