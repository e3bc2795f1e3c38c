"""Query op8_bpe."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.llm import bpe
from marquee.llm.common import read


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir):
    """doc_id, n_tokens, and digests of the ids and of the text that they decode to."""
    ids = bpe.encode(read(spark, sf_dir, "documents"), vocabulary()).withColumns(
        {"n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256)})
    back = bpe.decode(ids, vocabulary(), keep=("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
