"""Vectorised helpers over the UTF-8 bytes of Arrow string columns.

Tasks see a column as one byte buffer with row offsets; words, shingles and
rolling hashes are numpy passes over slices of half a megabyte, so a task's
memory follows the slice and not the batch.  Nulls read as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
U = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE_KEY = _RNG.integers(1, 2**64, 256, dtype=U)
BASE = int(_RNG.integers(1, 2**63, dtype=U)) * 2 + 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def row_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end and the n + 1 offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when a longer slice comes."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE + 1)
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                steps = np.full(size, U(b))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


POWERS = Powers(BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE_KEY) -> np.ndarray:
    """Sums whose differences are the hashes of every substring of ``data``."""
    up, _ = POWERS.to(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * up[:len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each substring [start, end); equal strings hash alike wherever they stand."""
    _, down = POWERS.to(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def fixed_hash(sums: np.ndarray, length: int) -> np.ndarray:
    """The hash of the substring of ``length`` bytes at every start (``span_hash``, without gathers)."""
    n = len(sums) - length
    if n <= 0:
        return np.zeros(0, U)
    _, down = POWERS.to(len(sums))
    return mix((sums[length:] - sums[:n]) * down[:n] + U(length * 0xD6E8FEB86659FD93 % 2**64))


def word_spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with ``inside``; runs end at ``bounds``."""
    mask = np.zeros(len(data) + 1, bool)
    mask[:-1] = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~mask))
    return starts, ends


def pieces(data: np.ndarray, inside: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes of one long text, cut only outside words."""
    i, n = 0, len(data)
    while i < n:
        j = min(n, i + limit)
        while j < n:
            out = np.flatnonzero(~inside[data[j:j + limit]])
            if len(out):
                j += int(out[0])
                break
            j = min(n, j + limit)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray,
                fold: np.ndarray = LOWER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, hashes, word offsets by row) for each slice of rows: a hash of every word, letters folded."""
    table = BYTE_KEY[fold]
    for i, j in slices(offsets):
        part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        if j == i + 1 and len(part) > SLICE:
            found = [word_hashes_flat(part[a:b], np.zeros(1, np.int64), inside, table)[1] for a, b in pieces(part, inside)]
            hashes = np.concatenate(found)
            yield i, j, hashes, np.array([0, len(hashes)])
        else:
            starts, hashes = word_hashes_flat(part, own[:-1], inside, table)
            yield i, j, hashes, np.searchsorted(starts, own)


def word_hashes_flat(part: np.ndarray, bounds: np.ndarray, inside: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_spans(part, bounds, inside)
    return starts, span_hash(prefix_hash(part, table), starts, ends)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
