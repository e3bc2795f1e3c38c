"""Query op1_toxicity."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.llm import toxicity
from marquee.llm.common import read

TRAINS = "crc32(cast(doc_id as string)) % 3 <> 1"


def model(spark, docs, sf_dir):
    return toxicity.fit(docs, read(spark, sf_dir, "labels"), TRAINS)


def query(spark, sf_dir):
    """doc_id, held_out, score, predicted (score >= 0.7) of every document."""
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, model(spark, docs, sf_dir), ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
