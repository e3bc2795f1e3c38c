"""Corpus pipeline: documents in, cleaned and encoded documents out.

Each stage calls one operator of ``marquee.llm`` on all rows that its predecessor kept;
it is written as Parquet in the shared scratch folder and read again as the next stage's
``docs``.  All stages but the last return the columns of ``documents``.

Null or empty texts pass every stage (they are not toxic, equal nothing, hold nothing)
and encode to no ids.  Rows without a doc_id can't be named as a group's other members
and stay, once per text.  Other columns may have any name (stages work on the columns under
names of their own); columns named ids or n_tokens give way to those of the last stage.
"""

from __future__ import annotations

from marquee.llm import bpe, decontaminate, ngram_join, op1_toxicity, op8_bpe, suffix_dedup, toxicity
from marquee.llm.common import materialize, read
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns of the pipeline's own names, and which name each has: no column clashes with an operator's."""
    names = {c: f"column {k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of documents again."""
    return df.select(*[F.col(f"`{inner}`").alias(outer) for outer, inner in names.items()])


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is 0.7 or more go."""
    rows, names = renamed(docs)
    return columns(toxicity.score(rows, op1_toxicity.model(spark, docs, sf_dir), rows.columns, names["text"], below=0.7), names)


def one_of_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles (similarity 0.8 or more) the one with the smallest doc_id stays."""
    groups = ngram_join.ngram_components(docs, 5, 80, 100)
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 200-byte string that also starts elsewhere go; n_chars follows."""
    rows, names = renamed(docs)
    kept = suffix_dedup.remove_repeats(rows, 200, names["doc_id"], names["text"], as_text=True)
    length = F.when(F.col("n_removed") > 0, F.char_length(F.col(f"`{names['text']}`"))).otherwise(F.col(f"`{names['n_chars']}`"))
    return columns(kept.withColumn(names["n_chars"], length.cast(docs.schema["n_chars"].dataType)), names)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a segment of a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with the text as its ids decode to, ``ids`` and ``n_tokens``."""
    path = op8_bpe.vocabulary()
    docs = docs.drop("ids", "n_tokens")
    rows, names = renamed(docs)
    others = [c for c in names.values() if c != names["text"]]
    ids = bpe.encode(rows, path, names["text"], keep=tuple(f"`{c}`" for c in others))
    back = bpe.decode(ids.withColumn("encoded", F.col("ids")), path, keep=(*[f"`{c}`" for c in others], "encoded")).withColumnRenamed("text", names["text"])
    tokens = (F.octet_length("encoded") / 4).cast("long").alias("n_tokens")
    return back.select(*[F.col(f"`{inner}`").alias(outer) for outer, inner in names.items()], F.col("encoded").alias("ids"), tokens)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]
#: The stages are learned scores, set joins and byte-wise refinement: no SQL for them.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
