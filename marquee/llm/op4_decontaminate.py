"""Query op4_decontaminate."""

from __future__ import annotations

from marquee.llm.common import read
from marquee.llm.decontaminate import matches


def query(spark, sf_dir):
    """Each document and benchmark item that it holds a segment of (a short item: the whole of it), with places and edits."""
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), least=1)
