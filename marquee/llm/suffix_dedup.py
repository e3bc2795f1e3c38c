"""Operator 10: removal of repeated byte strings by hash refinement of sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else
(exact; strings never cross texts).  Suffixes are not all sorted: in every window of
``length`` bytes the q-gram with the smallest hash is the window's anchor, so equal
windows have equal anchors, and the suffixes at anchors (about one in 70 bytes) stand for
all.  Their buckets are refined from the q-gram outward, each level by direct
hashes of longer strings (not by identifiers of later offsets, as bucket-pointer refinement):

1. q-gram buckets.  A bucket with one suffix is done: none of its windows repeats.
2. whole contexts, the union of an anchor's windows.  Equal contexts are equal in all
   their windows and are done; one of them goes on to stand for the others.
3. in buckets that still hold several contexts, blocks of STEP windows: a block whose
   core (the intersection of its windows) is alone holds no repeat; blocks with equal
   unions repeat wholly.
4. the windows of the blocks that are left, one by one.

Every level is an aggregate by identifier with map-side partials and joins that AQE can
split; no bucket is gathered in a task.  Copies of whole texts count as one text on the
way (they go as a whole), so a third of all rows being one text costs nothing.

Null and empty texts, and texts shorter than ``length``, lose nothing.  A row repeated
with its id is a copy like any other.  Long texts are read in overlapping pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import columns_as, discard, materialize, over, written
from marquee.llm.textbytes import SLICE, U, fixed_hash, mix, prefix_hash, row_bytes, signed, slices, span_hash

GRAM = 64
STEP = 16
LOW = U((1 << 21) - 1)


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text, anchor, first and last window, q-gram hash, context hash) of every anchor in the rows' bytes.

    Rows end at ``offsets``; positions count from 0; at most 2**21 bytes."""
    width = length - GRAM + 1
    sums = prefix_hash(data)
    grams = fixed_hash(sums, GRAM)
    m = len(grams) - width + 1
    if m <= 0:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U)] * 2
    keys = np.full(-(-len(grams) // width) * width, ~U(0))
    keys[:len(grams)] = (grams & ~LOW) | np.arange(len(grams), dtype=U)
    keys = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(keys, axis=1).ravel()
    behind = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:m], ahead[width - 1:width - 1 + m]) & LOW).astype(np.int64)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)[:m]
    whole = np.flatnonzero(np.arange(m) + length <= offsets[1:][text])
    anchor, text = anchor[whole], text[whole]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])) if len(whole) else whole
    first, last = whole[new], whole[np.append(new[1:], len(whole)) - 1] if len(whole) else whole
    at = anchor[new]
    return [text[new], at, first, last, grams[at], span_hash(sums, first, last + length) ^ mix((at - first).astype(U))]


def _slices(column: pa.Array, length: int):
    """(i, j, bytes, row offsets, anchors of rows i to j): positions count from the start of row i."""
    data, offsets = row_bytes(column)
    for i, j in slices(offsets):
        part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        if len(part) <= SLICE:
            yield i, j, part, own, _anchors(part, own, length)
            continue
        found = []
        for a in range(0, len(part), SLICE):
            piece = part[a:a + SLICE + length - 1]
            got = _anchors(piece, np.array([0, len(piece)]), length)
            found.append([got[0], *(x + a for x in got[1:4]), *got[4:]])
        yield i, j, part, own, [np.concatenate(x) for x in zip(*found)]


def _scan(length: int):
    def task(batch):
        node = batch.column(0).to_numpy(zero_copy_only=False)
        for i, _, _, _, (text, _, _, _, gram, ctx) in _slices(batch.column(1), length):
            order = np.lexsort((ctx, gram, text))
            text, gram, ctx = text[order], gram[order], ctx[order]
            same_gram = (text[1:] == text[:-1]) & (gram[1:] == gram[:-1])
            same = same_gram & (ctx[1:] == ctx[:-1])
            first = np.concatenate([[True], ~same])[:len(text)]
            again = np.zeros(len(text), np.int32)
            np.maximum.at(again, np.flatnonzero(same_gram), 1)
            np.maximum.at(again, np.flatnonzero(same_gram) + 1, 1)
            start = np.maximum.accumulate(np.where(first, np.arange(len(text)), 0)) if len(text) else order
            np.maximum.at(again, start[1:][same], 2)
            yield [signed(gram[first]), signed(ctx[first]), node[i + text[first]], again[first]]

    return task


def _cut_out(length: int):
    """The bytes of the listed contexts of each text."""
    def task(batch):
        wanted = batch.column(2)
        for i, j, part, _, (text, at, first, last, _, ctx) in _slices(batch.column(1), length):
            lists = wanted.slice(i, j - i)
            rows = np.repeat(np.arange(j - i), np.diff(lists.offsets.to_numpy()))
            asked = {(r, c): k for r, c, k in zip(rows.tolist(), lists.flatten().field(0).to_pylist(), lists.flatten().field(1).to_pylist())}
            out = []
            for t, a, f, e, c in zip(text.tolist(), at.tolist(), first.tolist(), last.tolist(), signed(ctx).tolist()):
                if (known := asked.pop((t, c), None)) is not None:
                    out.append((c, a - f, part[f:e + length].tobytes(), known))
            yield [list(x) for x in zip(*out)] if out else [[], [], [], []]

    return task


def _context_slices(batch):
    """Rows (context, offset of its anchor, bytes, ...) with their rolling sums."""
    data, offsets = row_bytes(batch.column(2))
    left = batch.column(1).to_numpy().astype(np.int64)
    for i, j in slices(offsets):
        own = offsets[i:j + 1] - offsets[i]
        yield i, j, left[i:j], own, prefix_hash(data[offsets[i]:offsets[j]])


def _blocks(length: int):
    def task(batch):
        ctx = batch.column(0).to_numpy()
        known = batch.column(3).to_numpy(zero_copy_only=False)
        for i, j, left, own, sums in _context_slices(batch):
            least = left - (np.diff(own) - length)  # offsets of windows before the anchor: least .. left
            k0, k1 = least // STEP, left // STEP
            row = np.repeat(np.arange(j - i), k1 - k0 + 1)
            k = np.arange(len(row)) - np.repeat(np.cumsum(k1 - k0 + 1) - (k1 - k0 + 1), k1 - k0 + 1) + k0[row]
            zero = own[:-1][row] + left[row]
            core = span_hash(sums, zero - k * STEP, zero - k * STEP - (STEP - 1) + length) ^ mix(k.astype(U) + U(7))
            d1, d2 = np.maximum(k * STEP, least[row]), np.minimum(k * STEP + STEP - 1, left[row])
            union = span_hash(sums, zero - d2, zero - d1 + length) ^ mix(d1.astype(U) + U(1000))
            yield [signed(core), signed(union), ctx[i + row], d1.astype(np.int32), d2.astype(np.int32), known[i + row]]

    return task


def _windows(length: int):
    """context, offset of its anchor, bytes, list of (d1, d2, known) -> a row per window."""
    def task(batch):
        ctx = batch.column(0).to_numpy()
        lists = batch.column(3)
        for i, j, left, own, sums in _context_slices(batch):
            part = lists.slice(i, j - i)
            flat = part.flatten()
            row = np.repeat(np.arange(j - i), np.diff(part.offsets.to_numpy()))
            d1, d2 = (flat.field(x).to_numpy().astype(np.int64) for x in (0, 1))
            size = d2 - d1 + 1
            of = np.repeat(np.arange(len(size)), size)
            d = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + d1[of]
            start = own[:-1][row[of]] + left[row[of]] - d
            yield [signed(span_hash(sums, start, start + length)), ctx[i + row[of]], d.astype(np.int32)]

    return task


def _remove(length: int):
    def task(batch):
        copy, lists = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3)
        for i, j, part, own, (text, at, first, last, _, ctx) in _slices(batch.column(1), length):
            mine = lists.slice(i, j - i)
            flat = mine.flatten()
            row = np.repeat(np.arange(j - i), np.diff(mine.offsets.to_numpy()))
            edge = np.zeros(len(part) + 1, np.int64)
            # anchors of a listed context: their windows from d2 to d1 before the anchor repeat
            here, told = signed(ctx), flat.field(0).to_numpy()
            by = np.lexsort((told, row))
            pairs = np.zeros(len(by), [("r", np.int64), ("c", np.int64)])
            pairs["r"], pairs["c"] = row[by], told[by]
            asked = np.zeros(len(here), pairs.dtype)
            asked["r"], asked["c"] = text, here
            lo, hi = _ranges(pairs, asked)
            of = np.repeat(np.arange(len(here)), hi - lo)
            nth = by[np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[of]] if len(of) else of
            d1, d2 = flat.field(1).to_numpy()[nth], flat.field(2).to_numpy()[nth]
            start = np.where(d1 < 0, first[of], at[of] - d2)
            end = np.where(d1 < 0, last[of], at[of] - d1) + length
            np.add.at(edge, start, 1)
            np.add.at(edge, end, -1)
            gone = np.cumsum(edge)[:-1] > 0
            kept, removed, spans = [], [], []
            for r in range(j - i):
                a, b = own[r], own[r + 1]
                mask = np.ones(b - a, bool) if copy[i + r] and b - a >= length else gone[a:b]
                removed.append(int(mask.sum()))
                spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                kept.append(part[a:b][~mask].tobytes())
            yield [batch.column(0).slice(i, j - i), np.diff(own), removed, spans, kept]

    return task


def _ranges(pairs: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked (r, c) stands in the sorted pairs."""
    if not len(pairs) or not len(asked):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    keys, inverse = np.unique(np.concatenate([pairs, asked]), return_inverse=True)
    own = inverse[:len(pairs)]
    return np.searchsorted(own, inverse[len(pairs):], "left"), np.searchsorted(own, inverse[len(pairs):], "right")


def _repeats(docs: DataFrame, length: int) -> DataFrame:
    """(node, ctx, d1, d2), written: which windows repeat, by text and context; d1 = -1: all of the context's."""
    rows = over(docs.select("node", "text"), _scan(length), "gram long, ctx long, node long, again int")
    buckets = rows.groupBy("gram").agg(F.min("node").alias("n1"), F.max("node").alias("n2"), F.max("again").alias("again"),
                                       F.min("ctx").alias("c1"), F.max("ctx").alias("c2")).where("n1 <> n2 or again > 0")
    open_ = written(rows.join(buckets.select("gram", (F.col("c1") != F.col("c2")).alias("mixed")), "gram"), "suffix-buckets")
    contexts = open_.groupBy("gram", "ctx", "mixed").agg(F.min("node").alias("n1"), F.max("node").alias("n2"), F.max("again").alias("again"))
    contexts = materialize(contexts.select("gram", "ctx", "mixed", F.col("n1").alias("node"), ((F.col("n1") != F.col("n2")) | (F.col("again") > 1)).alias("known")), "suffix-contexts")
    unsure = contexts.where("mixed").groupBy("gram").agg(F.min("known").alias("all_known")).where("not all_known").select("gram")
    asked = contexts.join(unsure, "gram", "left_semi").select("node", "ctx", "known")
    lists = asked.groupBy("node").agg(F.collect_list(F.struct("ctx", "known")).alias("asked"))  # of one text
    held = written(over(_one_text(docs, lists), _cut_out(length), "ctx long, lead int, bytes binary, known boolean"), "suffix-held")

    blocks = materialize(over(held, _blocks(length), "core long, whole long, ctx long, d1 int, d2 int, known boolean"), "suffix-blocks")
    kinds = blocks.groupBy("core", "whole").agg(F.min("ctx").alias("ctx"), F.max("known").alias("known"), F.count("*").alias("n"), F.first("d1").alias("d1"), F.first("d2").alias("d2"))
    kinds = materialize(kinds.withColumn("known", F.col("known") | (F.col("n") > 1)), "suffix-kinds")
    left = kinds.groupBy("core").agg(F.count("*").alias("k"), F.min("known").alias("all_known")).where("k > 1 and not all_known").select("core")
    todo = kinds.join(left, "core", "left_semi").select("ctx", "d1", "d2", "known")
    per = todo.groupBy("ctx").agg(F.collect_list(F.struct("d1", "d2", "known")).alias("todo"))  # of one context
    single = written(over(held.select("ctx", "lead", "bytes").join(per, "ctx"), _windows(length), "window long, ctx long, d int"), "suffix-windows")
    discard(held)
    twice = single.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    found = single.join(twice, "window", "left_semi").select("ctx", F.col("d").alias("d1"), F.col("d").alias("d2"))

    full = blocks.join(kinds.where("n > 1").select("core", "whole"), ["core", "whole"], "left_semi").select("ctx", "d1", "d2")
    unknown = contexts.where("not known").select("ctx", "node")
    part = full.unionByName(found).join(unknown, "ctx").select("node", "ctx", "d1", "d2")
    sure = open_.select("gram", "ctx", "node").join(contexts.where("known").select("gram", "ctx"), ["gram", "ctx"], "left_semi").select(
        "node", "ctx", F.lit(-1).alias("d1"), F.lit(-1).alias("d2"))
    out = written(sure.unionByName(part), "suffix-repeats")
    discard(open_, contexts, blocks, kinds, single)
    return out


def _one_text(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """node, text, asked: the text of each listed node, from its first copy."""
    first = docs.select("node", "id").join(lists.select("node"), "node", "left_semi").groupBy("node").agg(F.min("id").alias("one"))
    asked = lists.join(first, "node")
    return docs.join(asked.select(F.col("node").alias("of"), "one", "asked"), (F.col("node") == F.col("of")) & F.col("id").eqNullSafe(F.col("one"))).select(
        "node", "text", "asked")


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary) of every row.

    as_text: instead the rows as they were, with the kept bytes as their text (letters cut in two go)
    and n_removed."""
    kept = docs.columns
    given = docs
    docs = columns_as(docs, id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    docs = docs.withColumn("node", F.xxhash64("text"))
    own = docs.select("id", "node", F.sha2("text", 256).alias("sha"))
    copies = own.groupBy("node", "sha").agg(F.count("*").alias("n"))
    gone = _repeats(docs, length)
    lists = gone.groupBy("node").agg(F.collect_list(F.struct("ctx", "d1", "d2")).alias("gone"))  # of one text
    alone = copies.where("n = 1").select("node").join(lists, "node")
    told = own.join(copies.where("n > 1").select("node", "sha", F.lit(True).alias("copy")), ["node", "sha"], "left").join(alone, "node", "left").where(
        "copy or gone is not null").select(F.col("id").alias("tid"), F.col("node").alias("of"), F.coalesce("copy", F.lit(False)).alias("copy"), "gone").dropDuplicates(["tid", "of"])
    nothing = F.array().cast("array<struct<ctx:bigint,d1:int,d2:int>>")
    cols = [F.coalesce("text", F.lit("")).alias("text"), F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("gone", nothing).alias("gone")]
    met = (F.xxhash64("text") == F.col("of")) & F.col("id").eqNullSafe(F.col("tid"))
    if not as_text:
        rows = docs.drop("node").join(told, met, "left").select("id", *cols)
        kind = docs.schema["id"].dataType.simpleString()
        return over(rows, _remove(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)
    at, key = kept.index(text_col), kept.index(id_col)
    names = [f"c{k}" for k in range(len(kept))]
    rows = given.toDF(*names).withColumn("text", F.coalesce(F.col(names[at]).cast("string"), F.lit(""))).withColumn("id", F.col(names[key]))
    rows = rows.join(told, met, "left").select(*[n for k, n in enumerate(names) if k != at], *cols)
    inner = _remove(length)

    def task(batch):
        text, copy, gone = batch.columns[-3:]
        done = 0
        for _, _, removed, _, bytes_ in inner(pa.RecordBatch.from_arrays([text, text, copy, gone], names=["id", "text", "copy", "gone"])):
            part = [c.slice(done, len(removed)) for c in batch.columns[:-3]]
            done += len(removed)
            part.insert(at, pa.array([b.decode("utf-8", "ignore") for b in bytes_], pa.string()))
            yield [*part, removed]

    schema = ", ".join(f"`{n}` {'string' if k == at else given.schema[k].dataType.simpleString()}" for k, n in enumerate(names))
    return over(rows, task, f"{schema}, n_removed long").toDF(*kept, "n_removed")
