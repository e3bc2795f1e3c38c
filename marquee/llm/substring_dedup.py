"""Operator 11: removal of repeated word passages by relative Lempel-Ziv parsing.

A word goes if a window of ``length`` words that covers it also starts in a document with
a smaller id (exact; windows never cross texts and are judged on the input).

1. Index.  In every window the run of GRAM words with the smallest hash is its anchor, so
   equal windows have equal anchors (about one word in five is one).  An anchor's gram
   that stands in several documents is kept with its first place: the smallest id and the word there.
2. Reference blocks.  A document's words are cut into blocks of BLOCK words (with margins
   that hold the contexts of their anchors); blocks that hold a first place are references.
3. Parse.  Each later document's stretches of consecutive anchors with first places
   in one reference block meet that block (a join by block, which AQE can split) and are factored
   greedily against its index: at each word the longest match; a match of ``length`` words
   or more is a factor and thereby a duplicate span.  The windows that cross a factor's
   end are tried one by one, so no window that the block holds is missed.
4. Rest.  A window outside all factors can still repeat in documents that share
   its gram but are not the gram's first, or elsewhere in the first one.  Those windows (few)
   go, by two 64-bit hashes, to the smallest id that holds them.

Memory: a task holds a slice of texts, or one row of a block and a stretch.  Hot grams
and blocks are aggregates with map-side partials and joins; nothing is gathered by gram.

Words compare by 64-bit hashes.  Null and empty texts have no words.  Rows without an id
lose nothing and are no source.  Rows of equal id do not remove one another; a repeated row
comes back as often as it came.  Long texts are read in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import columns_as, discard, over, written
from marquee.llm.textbytes import SLICE, U, mix, pieces, prefix_hash, row_bytes, signed, slices, span_hash, word_spans

GRAM = 5
BLOCK = 512
PIECE = 1 << 16  # words whose anchors are sought at once
SPACES = np.ones(256, bool)
SPACES[[32, *range(9, 14)]] = False


def run_hash(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of the ``k`` words at every start."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, U(seed))
    for x in range(k):
        out = mix(out * U(0x9E3779B97F4A7C15) + words[x:x + n])
    return out


def texts(column: pa.Array):
    """(i, j, bytes, row offsets, word starts, word ends, word hashes, words before each row) by slices of rows."""
    data, offsets = row_bytes(column)
    for i, j in slices(offsets):
        part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        found = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)]]
        ranges = pieces(part, SPACES) if j == i + 1 and len(part) > SLICE else [(0, len(part))]
        for a, b in ranges:
            starts, ends = word_spans(part[a:b], own[:-1] if b - a == len(part) else np.zeros(1, np.int64), SPACES)
            found.append([starts + a, ends + a, span_hash(prefix_hash(part[a:b]), starts, ends)])
        starts, ends, hashes = (np.concatenate(x) for x in zip(*found))
        yield i, j, part, own, starts, ends, hashes, np.searchsorted(starts, own)


def anchors(words: np.ndarray, before: np.ndarray, length: int):
    """(row, anchor, first window, last window, gram) of the anchors of the rows that end at ``before``."""
    width = length - GRAM + 1
    found = [[np.zeros(0, np.int64)] * 4 + [np.zeros(0, U)]]
    row_of = np.repeat(np.arange(len(before) - 1), np.diff(before))
    for a in range(0, max(0, len(words) - length + 1), PIECE):
        part = words[a:a + PIECE + length - 1]
        grams = run_hash(part, GRAM)
        m = len(part) - length + 1
        keys = np.full(-(-len(grams) // width) * width, ~U(0))
        keys[:len(grams)] = (grams & ~U(PIECE * 2 - 1)) | np.arange(len(grams), dtype=U)
        keys = keys.reshape(-1, width)
        ahead = np.minimum.accumulate(keys, axis=1).ravel()
        behind = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:m], ahead[width - 1:width - 1 + m]) & U(PIECE * 2 - 1)).astype(np.int64)
        row = row_of[a:a + m]
        whole = np.flatnonzero(row == row_of[a + length - 1:a + length - 1 + m])
        if not len(whole):
            continue
        at, row = at[whole], row[whole]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
        last = whole[np.append(new[1:], len(whole)) - 1]
        found.append([row[new], at[new] + a, whole[new] + a, last + a, grams[at[new]]])
    return [np.concatenate(x) for x in zip(*found)]


def _first_places(length: int):
    """(id, text) -> a row per gram and document: gram, id, its first place."""
    def task(batch):
        ids = batch.column(0).to_numpy()
        for i, _, _, _, _, _, words, before in texts(batch.column(1)):
            row, at, _, _, gram = anchors(words, before, length)
            order = np.lexsort((at, row, gram))
            row, at, gram = row[order], at[order], gram[order]
            new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])])[:len(gram)]
            row, at, gram = row[new], at[new], gram[new]
            yield [signed(gram), ids[i + row], (at - before[row]).astype(np.int32)]

    return task


def _places(length: int):
    """(id, text) -> a row per anchor: gram, id, its place and (in the low bits) its windows: place, place - first, last - first."""
    def task(batch):
        ids = batch.column(0).to_numpy()
        for i, _, _, _, _, _, words, before in texts(batch.column(1)):
            row, at, first, last, gram = anchors(words, before, length)
            yield [signed(gram), ids[i + row], (at - before[row]) << 16 | (at - first) << 8 | (last - first)]

    return task


def _cut_out(length: int):
    """(id, text, node, asked places) -> reference blocks (role 0) and stretches to be parsed (role 1).

    asked: (gram, at, first, last, source, block); source null: the block of the document itself."""
    margin = length + GRAM

    def task(batch):
        ids, node, lists = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3)
        for i, j, _, _, _, _, words, before in texts(batch.column(1)):
            mine = lists.slice(i, j - i)
            flat = mine.flatten()
            row = np.repeat(np.arange(j - i), np.diff(mine.offsets.to_numpy()))
            gram, at, first, last, source, block = (flat.field(k).fill_null(0).to_numpy(zero_copy_only=False) for k in range(6))
            size = np.diff(before)[row]
            own = flat.field(4).is_null().to_numpy(zero_copy_only=False)
            # a request of another text of the same id does not fit here
            if len(words) >= GRAM:
                grams = signed(run_hash(words, GRAM))
                fits = (at + GRAM <= size) & (last + length <= size)
                fits &= grams[np.minimum(before[row] + at, len(grams) - 1)] == gram
            else:
                fits = np.zeros(len(row), bool)
            keep = np.flatnonzero(np.where(own, block * BLOCK < size, fits))
            keep = keep[np.lexsort((first[keep], own[keep], row[keep]))]
            row, first, last, source, block, own = (x[keep] for x in (row, first, last, source, block, own))
            joined = np.zeros(len(row), bool)  # goes on with the stretch of the place before
            joined[1:] = ~own[1:] & ~own[:-1] & (row[1:] == row[:-1]) & (source[1:] == source[:-1]) & (block[1:] == block[:-1]) & (first[1:] == last[:-1] + 1)
            lead = np.flatnonzero(~joined)
            ends = np.append(lead[1:], len(row)) - 1 if len(lead) else lead
            out = []
            for a, b in zip(lead.tolist(), ends.tolist()):
                r = row[a]
                zero, top = before[r], before[r + 1]
                if own[a]:
                    s, e = max(0, block[a] * BLOCK - margin), (block[a] + 1) * BLOCK + margin
                else:
                    s, e = first[a], last[b] + length
                out.append((ids[i + r] if own[a] else source[a], int(block[a]), 0 if own[a] else 1, ids[i + r], node[i + r], int(s),
                            words[zero + s:min(top, zero + e)].astype("<u8").tobytes()))
            yield [list(x) for x in zip(*out)] if out else [[]] * 7

    return task


class Block:
    """The index of a reference block: its windows by hash."""

    def __init__(self, words: np.ndarray, length: int):
        self.words, self.length = words, length
        hashes = run_hash(words, length)
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]

    def parse(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Factors [start, end) of at least ``length`` words: greedy, the longest match at each word."""
        hashes = run_hash(words, self.length)
        lo, hi = np.searchsorted(self.sorted, hashes, "left"), np.searchsorted(self.sorted, hashes, "right")
        hits = np.flatnonzero(hi > lo)
        out, at = [], 0
        while at < len(hits):
            p = int(hits[at])
            best = 0
            for r in self.order[lo[p]:hi[p]].tolist():
                n = min(len(words) - p, len(self.words) - r)
                differ = np.flatnonzero(words[p:p + n] != self.words[r:r + n])
                best = max(best, int(differ[0]) if len(differ) else n)
            if best < self.length:  # equal hashes of different windows
                at += 1
                continue
            out.append((p, p + best))
            # next: the first window that crosses this factor's end
            at = int(np.searchsorted(hits, p + best - self.length + 1))
        return out


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a binary column end to end, and the rows' offsets among them."""
    data, offsets = row_bytes(column)
    return np.frombuffer(data.tobytes(), "<u8"), offsets // 8


def _parse(length: int):
    """(source, block, block words, id, node, start, words), blocks together -> spans (role 0), windows outside all factors (role 1).

    Where no window of a stretch stands twice in its block, its factors are the runs of windows that match one
    after the other; the other stretches are factored one by one.  A document's own stretches beside its block have no
    factors: others may hold their windows."""
    def task(batch):
        source, block, ids, node, start = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4, 5))
        first = np.concatenate([[True], (source[1:] != source[:-1]) | (block[1:] != block[:-1])])[:len(source)]
        group = np.cumsum(first) - 1
        refs, ref_at = _words(batch.column(2).take(pa.array(np.flatnonzero(first))))
        own, own_at = _words(batch.column(6))
        h1 = run_hash(own, length)
        row = np.repeat(np.arange(len(ids)), np.diff(own_at))
        inside = row[:len(h1)] == row[length - 1:length - 1 + len(h1)]
        of = np.repeat(np.arange(len(ref_at) - 1), np.diff(ref_at))
        ref_h = run_hash(refs, length)
        ref_in = np.flatnonzero(of[:len(ref_h)] == of[length - 1:length - 1 + len(ref_h)])
        keys = ref_h[ref_in] ^ mix(of[ref_in].astype(U) + U(1))  # a block's windows meet only that block's stretches
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], ref_in[order]
        asked = h1 ^ mix(group[row[:len(h1)]].astype(U) + U(1))
        lo, hi = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
        met = inside & (hi > lo) & (ids > source)[row[:len(h1)]]
        twice = np.zeros(len(ids), bool)
        twice[row[:len(h1)][met & (hi > lo + 1)]] = True
        p = np.flatnonzero(met & ~twice[row[:len(h1)]])
        r = places[lo[p]] if len(p) else p
        same = np.ones(len(p), bool)
        for x in range(length):  # hashes may collide, words decide
            same &= own[p + x] == refs[r + x]
        p, r = p[same], r[same]
        lead = np.concatenate([[True], (p[1:] != p[:-1] + 1) | (r[1:] != r[:-1] + 1) | (row[p[1:]] != row[p[:-1]])])[:len(p)]
        a = p[lead]
        e = p[np.append(np.flatnonzero(lead)[1:], len(p)) - 1] + length if len(p) else p
        factors = [(a, e)]
        left = inside.copy()
        left[p] = False
        for k in np.flatnonzero(twice).tolist():
            zero = own_at[k]
            found = Block(refs[ref_at[group[k]]:ref_at[group[k] + 1]], length).parse(own[zero:own_at[k + 1]])
            for s, t in found:
                left[zero + s:zero + t - length + 1] = False
            factors.append((np.array([s for s, _ in found], np.int64) + zero, np.array([t for _, t in found], np.int64) + zero))
        a, e = (np.concatenate(x) for x in zip(*factors))
        shift = start - own_at[:-1]
        k, none = row[a] if len(a) else a, np.zeros(len(a), np.int64)
        yield [none, ids[k], node[k], a + shift[k], e + shift[k], none, none]
        a = np.flatnonzero(left)
        k = row[a]
        h2 = run_hash(own, length, 0x5851F42D4C957F2D)
        yield [np.ones(len(a), np.int64), ids[k], node[k], a + shift[k], a + length + shift[k], signed(h1[a]), signed(h2[a])]

    return task


def _remove(batch):
    """(row columns ..., text, spans) -> id, n_words, n_removed, kept words joined by one space."""
    ids, lists = batch.column(0), batch.column(2)
    for i, j, part, own, starts, ends, _, before in texts(batch.column(1)):
        mine = lists.slice(i, j - i)
        flat = mine.flatten()
        zero = before[np.repeat(np.arange(j - i), np.diff(mine.offsets.to_numpy()))]
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, flat.field(0).to_numpy() + zero, 1)
        np.add.at(edge, flat.field(1).to_numpy() + zero, -1)
        kept = np.cumsum(edge)[:-1] <= 0
        row = np.repeat(np.arange(j - i), np.diff(before))
        at = np.flatnonzero(kept)
        final = np.concatenate([row[at][1:] != row[at][:-1], [True]])[:len(at)]  # the row's last kept word
        mask = np.zeros(len(part) + 1, np.int32)
        np.add.at(mask, starts[at], 1)
        np.add.at(mask, ends[at], -1)
        mask = np.cumsum(mask)[:-1] > 0
        joint = ends[at[~final]]  # a word follows, so a separator stands here
        part = part.copy()
        part[joint], mask[joint] = 32, True
        cut = np.concatenate([[0], np.cumsum(mask)])[own]
        body = part[mask].tobytes()
        gone = np.bincount(row[~kept], minlength=j - i)
        yield [ids.slice(i, j - i), np.diff(before), gone, [body[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]]


def spans(docs: DataFrame, length: int) -> DataFrame:
    """(doc, node, s, e): words [s, e) of the texts (by xxhash64, ``node``) that repeat an earlier document's."""
    rows = docs.where("id is not null").select(F.col("id").cast("long").alias("id"), "text")
    first = over(rows, _first_places(length), "gram long, doc long, at int")
    shared = first.groupBy("gram").agg(F.min("doc").alias("source"), F.max("doc").alias("top"), F.min_by("at", "doc").alias("at"))
    shared = written(shared.where("source < top").select("gram", "source", F.expr(f"cast(at div {BLOCK} as int)").alias("block")), "substring-grams")

    places = over(rows, _places(length), "gram long, doc long, place long")
    at = F.expr("cast(shiftright(place, 16) as int)")
    asked = places.join(shared, "gram").withColumn("at", at).where(f"doc > source or at div {BLOCK} <> block")
    asked = asked.withColumn("first", F.expr("at - cast(shiftright(place, 8) & 255 as int)")).withColumn("last", F.expr("first + cast(place & 255 as int)"))
    own = shared.select("source", "block").distinct().select(
        F.lit(0).cast("long").alias("gram"), F.col("source").alias("doc"), F.lit(0).alias("at"), F.lit(0).alias("first"), F.lit(0).alias("last"),
        F.lit(None).cast("long").alias("source"), "block")
    wanted = asked.select("gram", "doc", "at", "first", "last", "source", "block").unionByName(own)
    lists = written(wanted.groupBy("doc").agg(F.collect_list(F.struct("gram", "at", "first", "last", "source", "block")).alias("asked")), "substring-asked")  # of one text
    met = rows.join(lists, rows["id"] == lists["doc"]).select("id", "text", F.xxhash64("text").alias("node"), "asked")
    cuts = written(over(met, _cut_out(length), "source long, block int, role int, doc long, node long, start int, words binary"), "substring-cuts")
    discard(shared, lists)

    refs = cuts.where("role = 0").select("source", "block", F.col("words").alias("reference"))
    todo = cuts.where("role = 1").select("source", "block", "doc", "node", "start", "words")
    pairs = todo.join(refs, ["source", "block"]).select("source", "block", "reference", "doc", "node", "start", "words")
    parsed = written(over(pairs, _parse(length), "role int, doc long, node long, s int, e int, h1 long, h2 long"), "substring-parsed")
    discard(cuts)
    rest = parsed.where("role = 1")
    holders = rest.groupBy("h1", "h2").agg(F.min("doc").alias("holder"), F.max("doc").alias("top")).where("holder < top").select("h1", "h2", "holder")
    more = rest.join(holders, ["h1", "h2"]).where("doc > holder").select("doc", "node", "s", "e")
    return parsed.where("role = 0").select("doc", "node", "s", "e").unionByName(more)


def remove_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept (UTF-8 bytes: the kept words joined by one space) of every row."""
    if not GRAM <= length <= 200:
        raise ValueError(f"length must be between {GRAM} and 200 words")
    kind = docs.schema[id_col].dataType.simpleString()
    docs = columns_as(docs, id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = spans(docs, length)
    lists = written(found.groupBy("doc", "node").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "substring-spans")  # of one text
    met = (F.col("id").cast("long") == F.col("doc")) & (F.xxhash64("text") == F.col("node"))
    rows = docs.join(lists, met, "left").select("id", "text", F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"))
    return over(rows, _remove, f"id {kind}, n_words long, n_removed long, kept binary").withColumnRenamed("id", id_col)
