"""Operator 4: benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared as bytes with A-Z lower-cased and every run of ASCII punctuation and
white space as one space.  A document matches an item if any SEGMENT bytes of it, at
whatever offset, stand in the document with at most RATE of edits (shorter items as a
whole; items under LEAST bytes only if ``least`` asks for them, and then word for word, as whole words).  A segment of
n bytes that stands in a document with at most e edits shares at least n - q + 1 - q e
q-grams with it, all within e + 1 diagonals; so the shared q-grams of whole items are
counted in diagonal bands of width 2 (E + 1) that overlap by half, and every segment that
reaches the bound in a band is verified by a banded alignment.  Templated items share q-grams
by thousands: a q-gram that more than HOT places share is not expanded, and the bound falls by the
number of such q-grams in the segment; segments of which that leaves nothing are counted by shorter q-grams.

The benchmark is a query set: it is indexed in blocks of at most BLOCK bytes, each sent
to the tasks and run over all documents in one scan without a shuffle, whatever
the benchmark's size.  Null or empty items and texts match nothing.  Repeated rows are
judged alike; equal items all match.  Long texts are read in pieces that overlap by more
than a segment of folded bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import kept, columns_as, over
from marquee.llm.textbytes import LOWER, SLICE, U, fixed_hash, prefix_hash, row_bytes, slices

GRAM, SEGMENT, LEAST, RATE = 12, 80, 24, 0.05
GRAMS = (GRAM, 6, 4)  # lengths by which segments are counted, where rare ones of the longer do not tell
HOT = 48  # places that a counted q-gram stands at, at most
STRETCH = 1 << 16  # bytes of text whose q-grams are expanded at once
MOST = int(SEGMENT * RATE)
BAND = MOST + 1
BLOCK = 4 << 20
BITS = 22
SPACE = 0x20
END = 0xFF  # no byte of UTF-8: between rows, before and behind a text; no alignment crosses it
CHUNK = 2048
FOLD = LOWER.copy()
FOLD[[b for b in range(128) if not chr(b).isalnum()]] = SPACE


def normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes, and where each stood."""
    folded = FOLD[data]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != SPACE) | (folded[:-1] != SPACE)
    at = np.flatnonzero(keep)
    return folded[at], at


class Level:
    """The q-grams of one length that some segments are counted by: those that few places share (all of them at the last level).

    ``need[o]``: how many of them a copy of the segment at offset o must hold; 0: another level counts that segment."""

    def __init__(self, q: int, hashes: np.ndarray, counted: np.ndarray, need: np.ndarray, sizes: np.ndarray, item: np.ndarray, items: int):
        self.q, self.need = q, need
        mine = np.flatnonzero(need)
        cover = np.zeros(len(need) + 1, np.int64)  # places within a segment of this level
        np.add.at(cover, mine, 1)
        np.add.at(cover, mine + sizes[mine] - q + 1, -1)
        place = np.flatnonzero(counted & (np.cumsum(cover)[:len(need)] > 0))
        order = np.argsort(hashes[place], kind="stable")
        self.grams, self.place = hashes[place][order], place[order]
        self.least = np.full(items, np.iinfo(np.int64).max)  # of an item's segments
        np.minimum.at(self.least, item[mine], need[mine])
        self.least[self.least == np.iinfo(np.int64).max] = 1
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[(self.grams >> U(64 - BITS)).astype(np.int64)] = True


class Index:
    """The q-grams of a block of benchmark items, which stand end to end.

    A segment is counted by its long q-grams that at most HOT places share, its need lowered by the others that it
    has.  Where that leaves no need (much of it is a template of many items), its shorter q-grams count, by
    the same rule; what is left then stands in many items almost alike, and is counted by all its q-grams."""

    def __init__(self, items: list[tuple[int | None, str]], least: int = LEAST):
        self.items = [i for i, _ in items]
        parts, owner = [], []
        self.start = np.zeros(len(items), np.int64)
        sizes = np.zeros(len(items), np.int64)
        self.short: dict[int, dict[bytes, list[int]]] = {}
        total = 0
        for k, (_, text) in enumerate(items):
            whole = np.frombuffer(normal(np.frombuffer(text.encode(), np.uint8))[0].tobytes().strip(b" "), np.uint8)
            if least <= len(whole) < LEAST and len(whole):
                self.short.setdefault(len(whole), {}).setdefault(whole.tobytes(), []).append(k)
            if len(whole) < LEAST:
                continue
            parts.append(whole)
            owner.append(np.full(len(whole), k))
            self.start[k], sizes[k] = total, len(whole)
            total += len(whole)
        self.text = np.concatenate(parts or [np.zeros(0, np.uint8)])
        self.owner = np.concatenate(owner or [np.zeros(0, np.int64)])
        self.end = self.start + sizes
        self.size = np.minimum(sizes, SEGMENT)
        self.edits = (self.size * RATE).astype(np.int64)
        self.levels: list[Level] = []
        if not total:
            return
        size, edits = self.size[self.owner], self.edits[self.owner]
        left = np.arange(total) + size <= self.end[self.owner]  # the offsets at which a segment starts
        for q in GRAMS:
            hashes, inside = self._grams(q)
            _, of, count = np.unique(hashes, return_inverse=True, return_counts=True)
            counted = inside & (count[of] <= HOT)
            common = np.concatenate([[0], np.cumsum(inside & ~counted)])
            at = np.flatnonzero(left)
            need = np.zeros(total, np.int64)
            need[at] = np.maximum(0, size[at] - q + 1 - q * edits[at] - (common[at + size[at] - q + 1] - common[at]))
            if need.any():
                self.levels.append(Level(q, hashes, counted, need, size, self.owner, len(items)))
                left &= need == 0
        if left.any():
            need = np.where(left, np.maximum(1, size - GRAM + 1 - GRAM * edits), 0)
            self.levels.append(Level(GRAM, *self._grams(GRAM), need, size, self.owner, len(items)))

    def _grams(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the q-gram at each place, and which of them lie within an item."""
        hashes, inside = np.zeros(len(self.text), U), np.zeros(len(self.text), bool)
        found = fixed_hash(prefix_hash(self.text), q)
        hashes[:len(found)] = found
        inside[:len(found)] = self.owner[:len(found)] == self.owner[q - 1:q - 1 + len(found)]
        return hashes, inside

    def find(self, text: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item's place, segment's offset, start, end, edits) of every segment in every band that holds it, in the folded text."""
        found: set = set()
        for level in self.levels:
            for a in range(0, max(1, len(text)), STRETCH):  # pieces that overlap by more than a segment and its edits
                piece = text[a:a + STRETCH + 2 * SEGMENT]
                found.update((k, o, s + a, e + a, c) for k, o, s, e, c in self._level(level, piece))
                if a + STRETCH + 2 * SEGMENT >= len(text):
                    break
        for n, known in self.short.items():
            if len(text) >= n:
                edge = np.ones(len(text) + 2, bool)
                edge[1:-1] = (text == SPACE) | (text == END)
                for p in np.flatnonzero(edge[:len(text) - n + 1] & edge[n + 1:]).tolist():
                    found.update((k, 0, p, p + n, 0) for k in known.get(text[p:p + n].tobytes(), ()))
        return sorted(found)

    def _level(self, level: Level, text: np.ndarray) -> set:
        hashes = fixed_hash(prefix_hash(text), level.q)
        near = np.flatnonzero(level.bits[(hashes >> U(64 - BITS)).astype(np.int64)])
        if not len(near):
            return set()
        lo, hi = np.searchsorted(level.grams, hashes[near], "left"), np.searchsorted(level.grams, hashes[near], "right")
        n = hi - lo
        row = np.repeat(np.arange(len(near)), n)
        place = level.place[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]]
        total = len(self.text)
        band = (near[row] - place + total) // BAND  # never negative
        # distinct q-gram places in each of the two bands that hold the diagonal
        keys = np.unique(np.concatenate([band * total + place, (band + 1) * total + place]))
        band, place = keys // total, keys % total
        own = self.owner[place]
        # the first and the last of as many q-grams as one of the item's segments needs
        last = np.arange(len(keys)) + level.least[own] - 1
        first = np.flatnonzero(last < len(keys))
        last = last[first]
        reach = self.size[own[first]] - level.q
        first = first[(band[first] == band[last]) & (own[first] == own[last]) & (place[last] - place[first] <= reach)]
        last = first + level.least[own[first]] - 1
        k, b = own[first], band[first]
        # the segments that hold them: offsets from ``low`` to ``high``, each once in a band
        low = np.maximum(place[last] - (self.size[k] - level.q), self.start[k])
        high = np.minimum(place[first], self.end[k] - self.size[k])
        again = np.zeros(len(k), bool)
        again[1:] = (k[1:] == k[:-1]) & (b[1:] == b[:-1])
        low[1:] = np.where(again[1:], np.maximum(low[1:], high[:-1] + 1), low[1:])
        n = np.maximum(high - low + 1, 0)
        row = np.repeat(np.arange(len(k)), n)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
        k, b = k[row], b[row]
        # what this very segment needs
        enough = np.searchsorted(keys, b * total + offset + self.size[k] - level.q, "right") - np.searchsorted(keys, b * total + offset, "left")
        fit = (level.need[offset] > 0) & (enough >= level.need[offset])
        offset, k, b = offset[fit], k[fit], b[fit]
        side = 2 * (SEGMENT + 2 * BAND + 2 * MOST)
        padded = np.concatenate([np.full(side, END, np.uint8), text, np.full(side, END, np.uint8)])
        found = set()
        for size in np.unique(self.size[k]).tolist():
            for rows in np.array_split(r := np.flatnonzero(self.size[k] == size), -(-len(r) // CHUNK)):
                # the lowest diagonal of the band, less the edits
                at = offset[rows] + (b[rows] - 1) * BAND - total - MOST
                parts = self.text[offset[rows] + np.arange(size)[:, None]]
                windows = padded[np.clip(at + side, 0, len(padded) - side) + np.arange(size + 2 * BAND + 2 * MOST)[:, None]]
                cost, start, end = aligned(parts, windows)
                good = np.flatnonzero(cost <= self.edits[k[rows]])
                own = k[rows][good]
                found.update(zip(own.tolist(), (offset[rows][good] - self.start[own]).tolist(), (at[good] + start[good]).tolist(),
                                 (at[good] + end[good]).tolist(), cost[good].tolist()))
        return found


def aligned(parts: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best place of each column of ``parts`` in that column of ``windows``, on the diagonals
    from 0 to the difference of their lengths; END in a window is never crossed."""
    size, width = len(parts), len(windows) - len(parts) + 1
    one = 1 << 12  # an edit; the start of the place is kept below it
    wall = one << 8
    step = np.where(windows == END, wall, one).astype(np.int32)
    extra = np.zeros((len(windows) + 1, windows.shape[1]), np.int64)  # what reading the window's letters so far would cost
    np.cumsum(step, axis=0, out=extra[1:])
    # by diagonal: edits, then start
    cost = np.repeat(np.arange(width, dtype=np.int64)[:, None], windows.shape[1], axis=1)
    for i in range(size):
        nxt = cost + np.where(windows[i:i + width] == parts[i], 0, step[i:i + width])
        np.minimum(nxt[:-1], cost[1:] + one, out=nxt[:-1])  # the part's letter is missing in the window
        base = extra[i + 1:i + 1 + width]
        nxt -= base
        np.minimum.accumulate(nxt, axis=0, out=nxt)  # letters of the window are extra
        nxt += base
        cost = nxt
    best = cost.argmin(axis=0)
    value = cost[best, np.arange(len(best))]
    return value // one, value % one, best + size


def align(part: bytes, window: bytes, most: int, low: int, width: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best place of ``part`` in ``window`` on diagonals low .. low + width, or None beyond ``most`` edits."""
    padded = np.full(len(part) + width, END, np.uint8)
    inside = np.arange(max(0, low), min(len(window), low + len(padded)))
    padded[inside - low] = np.frombuffer(window, np.uint8)[inside]
    cost, start, end = aligned(np.frombuffer(part, np.uint8)[:, None], padded[:, None])
    return (low + int(start[0]), low + int(end[0]), int(cost[0])) if cost[0] <= most else None


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of at most BLOCK bytes of text (or of one longer item), streamed through the driver."""
    block, size = [], 0
    for row in columns_as(benchmark, item=item_col, text=text_col).where("text is not null").orderBy("item", "text").toLocalIterator():
        if block and size + len(row.text) > BLOCK:
            yield block
            block, size = [], 0
        block.append((row.item, row.text))
        size += len(row.text)
    if block:
        yield block


def _index(shared, least: int) -> Index:
    return kept("decontaminate", (hash(tuple(shared.value)), least), lambda: Index(shared.value, least))


def _pieces(part: np.ndarray):
    """The folded bytes of one long text and where each stood, in pieces that overlap by two segments."""
    text, at = np.zeros(0, np.uint8), np.zeros(0, np.int64)
    for a in range(0, max(1, len(part)), SLICE):
        more, stood = normal(part[a:a + SLICE])
        if len(text) and len(more) and text[-1] == more[0] == SPACE:  # one run, cut
            more, stood = more[1:], stood[1:]
        text, at = np.concatenate([text[-2 * SEGMENT:], more]), np.concatenate([at[-2 * SEGMENT:], stood + a])
        yield text, at


def _rows(column: pa.Array, index: Index):
    """(row, item's place, segment's offset, start, end, edits) in the bytes of each row."""
    data, offsets = row_bytes(column)
    for i, j in slices(offsets):
        if j == i + 1:
            found = set()
            for text, at in _pieces(data[offsets[i]:offsets[j]]):
                found.update((k, o, int(at[s]), int(at[e - 1]) + 1, c) for k, o, s, e, c in index.find(text))
            yield from ((i, *x) for x in sorted(found))
            continue
        # rows end to end, END between them
        own = offsets[i:j + 1] - offsets[i]
        rows = np.repeat(np.arange(j - i), np.diff(own))
        joined = np.full(own[-1] + j - i, END, np.uint8)
        joined[np.arange(own[-1]) + rows] = data[offsets[i]:offsets[j]]
        text, at = normal(joined)
        starts = own[:-1] + np.arange(j - i)
        for k, o, s, e, c in index.find(text):
            s0, e0 = int(at[s]), int(at[e - 1]) + 1
            r = int(np.searchsorted(starts, s0, "right")) - 1
            yield i + r, k, o, s0 - int(starts[r]), e0 - int(starts[r]), c


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, item_id, n_segments, first_byte, last_byte, least_edits) for each document and item with a matched segment;
    n_segments counts the item's offsets at which one starts.  Items of ``least`` to LEAST - 1 folded bytes match as whole words."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, item_id long, n_segments int, first_byte long, last_byte long, least_edits int"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK bytes

        def task(batch, shared=shared):
            index = _index(shared, least)
            by: dict[tuple[int, int], list] = {}
            for r, k, o, s, e, c in _rows(batch.column(1), index):
                by.setdefault((r, k), []).append((o, s, e, c))
            keys = list(by)
            yield [batch.column(0).take(pa.array([r for r, _ in keys], pa.int64())), [index.items[k] for _, k in keys], [len({o for o, *_ in by[x]}) for x in keys],
                   [min(s for _, s, _, _ in by[x]) for x in keys], [max(e for *_, e, _ in by[x]) for x in keys], [min(c for *_, c in by[x]) for x in keys]]

        out = out.unionByName(over(rows, task, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` without the rows that hold a matched segment of any item of ``least`` folded bytes or more."""
    k = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK bytes

        def task(batch, shared=shared):
            bad = np.zeros(batch.num_rows, bool)
            bad[[r for r, *_ in _rows(batch.column(k), _index(shared, least))]] = True
            yield batch.filter(pa.array(~bad)).columns

        docs = over(docs, task, schema)
    return docs
