"""Operator 6: n-gram Jaccard self-join by rare-first prefix filtering.

Each document is the set of its distinct word n-grams (64-bit hashes; fewer words
than n: the whole sequence as one).  Sets are ordered rare-first: by a count sketch of
n-gram frequencies over all documents, ties by hash.  Two sets of similarity t share an
n-gram among the first n - ceil(t n) + 1 of each, so only those prefixes are joined.

1. One scan gives each document's set size, identity (equal sets are one *class*; a
   class meets the join once, however many copies it has) and suffix-filter counts,
   and the sketch, whose size is fixed (one for each task of the scan).
2. A second scan gives the prefixes, once; n-grams that only one class has are dropped
   where the rows of an n-gram meet (its min and max class), the rest are joined.
3. Candidates come in passes.  In the first, each class meets the hub of each prefix n-gram
   it has: the class with the largest share of n-grams that others have too, for a group of
   near copies their common origin (rows linear in the input).  The verified links give
   components.  In the second, classes meet the hub of the n-gram's classes outside its
   largest component.  In the last, in the n-grams whose classes are still in several
   components, the classes outside the largest meet all classes of other components.
   Pairs that are in one component already need no test: a group of thousands of near
   copies is never expanded to all its pairs, and no link between components is lost.
4. Pairs pass the length filter, the positional filter (shared prefix n-grams plus what
   can follow the last shared one) and the suffix filter (the counts in 64 WORDS fixed parts
   of the hash range: every part whose parity differs holds an n-gram that one set lacks),
   and are verified once on their texts.

Null and empty texts have empty sets and no links.  Repeated rows are copies.  Rows with
the same doc_id are one vertex.  A null doc_id takes part as a copy only.  Long texts are
read in pieces; memory follows the number of their words.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import columns_as, discard, materialize, over, over_parts, written
from marquee.plans.components import components
from marquee.llm.textbytes import U, mix, row_bytes, signed, word_hashes

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
SKETCH = 1 << 17
WORDS = 16
PART_BITS = 6 + WORDS.bit_length() - 1
BITS = [f"b{k}" for k in range(WORDS)]


def _sets(column: pa.Array, n: int):
    """(hashes, offsets by row) for each slice of rows: the sorted distinct n-gram hashes of every row, end to end."""
    data, offsets = row_bytes(column)
    keys = mix(np.arange(1, n + 1, dtype=U)) | U(1)
    for _, _, words, at in word_hashes(data, offsets, NOT_SPACE):
        m = len(words)
        grams = np.zeros(max(0, m - n + 1), U)
        for k in range(n):
            grams += mix(words[k:k + len(grams)] * keys[k])
        grams = mix(grams)
        rows = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= n:
                rows.append(grams[a:b - n + 1])
                rows[-1].sort()
            elif b > a:
                rows.append(mix(np.add.reduce(mix(words[a:b] * keys[:b - a])) + np.array([b - a], U)))
            else:
                rows.append(words[:0])
        flat, starts = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        new = np.ones(len(flat) + 1, bool)
        new[1:-1] = flat[1:] != flat[:-1]
        new[starts] = True
        yield flat[new[:-1]], np.concatenate([np.zeros(1, np.int64), np.cumsum(new[:-1])])[starts]


def _each(column: pa.Array, n: int):
    """The sorted distinct n-gram hashes of each row."""
    for flat, at in _sets(column, n):
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield flat[a:b]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of each row's values, modulo 2**64."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def _nodes(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _sums(mix(flat ^ U(0x5851F42D4C957F2D)), at)


def _parities(flat: np.ndarray, at: np.ndarray, rows: int = 256):
    """For each row, whether the count in each part of the hash range is odd, as WORDS integers; a few rows at a time."""
    for i in range(0, len(at) - 1, rows):
        own = at[i:i + rows + 1]
        k = len(own) - 1
        cells = np.repeat(np.arange(k), np.diff(own)) * (64 * WORDS) + (flat[own[0]:own[-1]] >> U(64 - PART_BITS)).astype(np.int64)
        odd = np.bincount(cells, minlength=k * 64 * WORDS) & 1
        yield np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(k, WORDS)


def _least_overlap(a, b, num: int, den: int):
    """The smallest i with den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


def _signature(n: int):
    """Rows of kind 0 for the documents of each batch; of kind 1 for the task's sketch, once at its end."""
    def task(batches):
        sketch = np.zeros(SKETCH, np.int64)
        for batch in batches:
            size, node, check, parts = [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros((0, WORDS), np.int64)]
            for flat, at in _sets(batch.column(1), n):
                size.append(np.diff(at))
                node.append(_nodes(flat, at))
                check.append(_sums(mix(flat ^ U(0x14057B7EF767814F)), at))
                parts.extend(_parities(flat, at))
                sketch += np.bincount((flat & U(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            bits = np.ascontiguousarray(np.concatenate(parts).T)
            yield [np.zeros(len(batch), np.int32), batch.column(0), signed(np.concatenate(node)), signed(np.concatenate(check)),
                   np.concatenate(size), *bits]
        used = np.flatnonzero(sketch)
        none = pa.nulls(len(used), pa.int64())
        yield [np.ones(len(used), np.int32), none, used, sketch[used], none, *[none] * WORDS]

    return task


def _prefixes(n: int, num: int, den: int, sketch: np.ndarray):
    """The prefix of each set, one row an n-gram; of equal sets in a batch, the first's."""
    def task(batch):
        gram, node, size, length, seen = [], [], [], [], set()
        for flat, at in _sets(batch.column(0), n):
            count = sketch[(flat & U(SKETCH - 1)).astype(np.int64)]
            for a, b, own in zip(at[:-1].tolist(), at[1:].tolist(), _nodes(flat, at).tolist()):
                if b > a and own not in seen:
                    seen.add(own)
                    p = b - a - -(-num * (b - a) // den) + 1
                    gram.append(flat[a:b][np.argsort(count[a:b], kind="stable")[:p]])
                    node.append(own)
                    size.append(b - a)
                    length.append(p)
        if gram:
            start = np.repeat(np.cumsum(length) - length, length)
            yield [signed(np.concatenate(gram)), signed(np.repeat(np.array(node, U), length)), np.repeat(np.array(size, np.int32), length),
                   (np.arange(len(start)) - start).astype(np.int32)]

    return task


def _verify(n: int, num: int, den: int):
    def task(batch):
        keep = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(_each(batch.column(2), n), _each(batch.column(3), n))):
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep[k] = shared > 0 and shared >= _least_overlap(len(x), len(y), num, den)
        rows = batch.filter(pa.array(keep))
        yield [rows.column(0), rows.column(1)]

    return task


def _apart():
    """At least as many n-grams as this are in one of the two sets only."""
    return reduce(add, [F.bit_count(F.col(x).bitwiseXOR(F.col(f"r_{x}"))) for x in BITS])


def _pairs(met: DataFrame, classes: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """Pairs (a, b) of documents, from rows of two classes that share a prefix n-gram, after the filters.

    ``every``: met has each prefix n-gram that a pair shares, so that their count bounds the overlap;
    otherwise the bound of a single shared n-gram is taken."""
    met = met.where((F.col("node") != F.col("r_node")) & (F.least("size", "r_size") * den >= F.greatest("size", "r_size") * num))
    first = F.col("node") < F.col("r_node")
    pair = met.select(
        F.least("node", "r_node").alias("a"), F.greatest("node", "r_node").alias("b"),
        F.when(first, F.col("size")).otherwise(F.col("r_size")).alias("na"), F.when(first, F.col("r_size")).otherwise(F.col("size")).alias("nb"),
        F.when(first, F.col("pos")).otherwise(F.col("r_pos")).alias("ia"), F.when(first, F.col("r_pos")).otherwise(F.col("pos")).alias("ib"))
    need = F.ceil(num * (F.col("na") + F.col("nb")) / F.lit(num + den))
    after = lambda i, j: F.least(F.col("na") - 1 - i, F.col("nb") - 1 - j)
    best = F.least("ia", "ib") + 1 + after(F.col("ia"), F.col("ib"))
    found = pair.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min(best).alias("best"), F.max("na").alias("na"), F.max("nb").alias("nb"),
                                       F.max("ia").alias("ia"), F.max("ib").alias("ib"))
    found = found.where((F.col("shared") + after(F.col("ia"), F.col("ib")) if every else F.col("best")) >= need)
    a = classes.select(F.col("node").alias("a"), F.col("rep").alias("rep_a"), *BITS)
    b = classes.select(F.col("node").alias("b"), F.col("rep").alias("rep_b"), *[F.col(x).alias(f"r_{x}") for x in BITS])
    return found.join(a, "a").join(b, "b").where(_apart() <= F.col("na") + F.col("nb") - 2 * need).where("rep_a <> rep_b").select(
        F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def _links(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    x = texts.select(F.col("rep").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("rep").alias("b"), F.col("text").alias("y"))
    full = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
    return over(full, _verify(n, num, den), "a long, b long").distinct()


def _hub_pairs(rows: DataFrame, others: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of ``others`` with the hub of each n-gram: of its ``rows``, the class with the largest share of shared n-grams."""
    hubs = rows.groupBy("gram").agg(*[F.max_by(c, "shared").alias(c) for c in rows.columns if c not in ("gram", "shared")])
    met = hubs.join(others, "gram")
    if "r_comp" in others.columns:
        met = met.where("comp <> r_comp")
    return _pairs(met, classes, num, den, every=False)


def _apart_rows(grams: DataFrame, links: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of the n-grams whose classes are in several components, with their component and the n-gram's largest one."""
    group = classes.join(components(links, "ngram-near"), F.col("rep") == F.col("vertex"), "left").select(
        "node", F.coalesce("component", "rep").alias("comp")).groupBy("node").agg(F.min("comp").alias("comp"))
    in_comp = written(grams.join(group, "node"), "ngram-grouped")
    sizes = in_comp.groupBy("gram", "comp").agg(F.count("*").alias("n"))
    split = sizes.groupBy("gram").agg(F.max_by("comp", "n").alias("largest"), F.count("*").alias("k")).where("k > 1").select("gram", "largest")
    apart = written(in_comp.join(split, "gram"), "ngram-apart")
    discard(in_comp)
    return apart


def ngram_components(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, class_id (smallest id with an equal set),
    component_id (smallest id reachable by links of Jaccard similarity >= num / den)."""
    docs = columns_as(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    scan = materialize(over_parts(docs, _signature(n), "kind int, id long, node long, chk long, size long, " + ", ".join(f"{x} long" for x in BITS)), "ngram-sets")
    members = scan.where("kind = 0").select("id", "node", "chk", F.col("size").cast("int").alias("size"), *BITS)
    counts = scan.where("kind = 1").groupBy("node").agg(F.sum("chk").alias("n")).toPandas()  # SKETCH rows at most
    sketch = np.zeros(SKETCH, np.int64)
    sketch[counts["node"].to_numpy()] = counts["n"].to_numpy()
    classes = members.where("size > 0").groupBy("node", "chk", "size").agg(F.min("id").alias("rep"), *[F.first(x).alias(x) for x in BITS])

    prefixes = over(docs.select("text"), _prefixes(n, num, den, sketch), "gram long, node long, size int, pos int")
    by_gram = Window.partitionBy("gram")
    several = prefixes.withColumns({"least": F.min("node").over(by_gram), "most": F.max("node").over(by_gram)}).where("least <> most")
    once = several.groupBy("gram", "node").agg(F.first("size").alias("size"), F.first("pos").alias("pos"))
    grams = written(once.withColumn("shared", F.count("*").over(Window.partitionBy("node")) / F.col("size")), "ngram-shared")
    here = classes.join(grams.select("node").distinct(), "node", "left_semi")
    classes_here = materialize(here, "ngram-classes")
    reps = classes_here.select("rep").distinct()
    texts = written(docs.withColumnRenamed("id", "rep").join(reps, "rep", "left_semi").distinct(), "ngram-texts")

    other = [F.col(c).alias(f"r_{c}") for c in ("node", "size", "pos")]
    tried = materialize(_hub_pairs(grams, grams.select("gram", *other), classes_here, num, den), "ngram-tried")
    links = written(_links(tried, texts, n, num, den), "ngram-links")

    apart = _apart_rows(grams, links, classes_here)
    discard(grams)
    others = apart.select("gram", *other, F.col("comp").alias("r_comp"))
    more = _hub_pairs(apart.where("comp <> largest").drop("largest"), others, classes_here, num, den).join(tried, ["a", "b"], "left_anti")
    more = materialize(more, "ngram-tried-2")
    near, links = links, written(links.unionByName(_links(more, texts, n, num, den)), "ngram-links-2")
    discard(near)

    # classes in one component stay in one: only the n-grams that were in several can still be
    before, apart = apart, _apart_rows(apart.drop("comp", "largest"), links, classes_here)
    discard(before)
    left = apart.where("comp <> largest").drop("largest", "shared")
    right = apart.select("gram", *other, F.col("comp").alias("r_comp"), "largest")
    bits = classes_here.select("node", *BITS).dropDuplicates(["node"])
    left = left.join(bits, "node")
    right = right.join(bits.withColumnsRenamed({x: f"r_{x}" for x in ["node", *BITS]}), "r_node")
    least = F.ceil(num * (F.col("size") + F.col("r_size")) / F.lit(num + den))
    met = left.join(right, "gram").where("comp <> r_comp and (r_comp = largest or node < r_node)").where(
        _apart() <= F.col("size") + F.col("r_size") - 2 * least).drop(*BITS, *[f"r_{x}" for x in BITS])
    rest = _pairs(met, classes_here, num, den, every=True).join(tried.unionByName(more), ["a", "b"], "left_anti")
    rest = written(rest, "ngram-rest")
    found = written(links.unionByName(_links(rest, texts, n, num, den)), "ngram-links-3")
    discard(apart, texts, classes_here, tried, more, links, rest)

    final = written(components(found, "ngram-comps"), "ngram-final")
    by_class = classes.select("node", "chk", "size", "rep").join(final, F.col("rep") == F.col("vertex"), "left").select(
        "node", "chk", "size", "rep", F.coalesce("component", "rep").alias("component"))
    return members.drop(*BITS).join(by_class, ["node", "chk", "size"], "left").select(
        F.col("id").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("rep")).otherwise(F.col("id")).alias("class_id"),
        F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))

