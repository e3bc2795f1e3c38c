"""Query op5_token_counts."""

from __future__ import annotations

from marquee.llm.common import read
from marquee.llm.token_counts import count_tokens, vocabulary


def query(spark, sf_dir):
    """doc_id, n_words, n_tokens of every document, by the pieces of a public 32,000-piece model."""
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
