"""Operator 8: byte-level BPE encoding and decoding.

Texts split at special tokens and then by the pre-tokenizer's pattern; each piece is a
doubly linked list of symbols, and a priority queue holds the merge rank of every
adjacent pair.  The lowest rank (leftmost first) merges; entries whose symbols have
since changed are stale and skipped.  Decoding concatenates the vocabulary's byte
strings.  Pieces repeat, so a worker keeps the ids of up to ``CACHE`` pieces.

Everything is one pass without a shuffle; a text is read in blocks cut where the
pattern splits anyway, so memory follows the encoded row.  Null and empty texts have no
ids.  Repeated rows are encoded alike; other columns pass through only if named.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marquee.llm.common import over
from marquee.llm.common import kept as kept_model
from marquee.llm.textbytes import row_bytes, slices

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CUT = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
BLOCK = 1 << 20
CACHE = 500_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 256 + rest.index(b)) for b in range(256)]


class Bpe(dict):
    """Piece -> its ids as little-endian 32-bit integers."""

    def __init__(self, config: str):
        super().__init__()
        model = json.loads(config)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.strings: dict[int, bytes] = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
                                          for s, i in (vocab | self.special).items()}
        self.single = [vocab[c] for c in letters]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = np.array(self.merge([self.single[b] for b in piece.encode()]), "<u4").tobytes()
        self[piece] = ids
        return ids

    def merge(self, symbol: list[int]) -> list[int]:
        n, merges = len(symbol), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*merges[pair], i, pair) for i in range(n - 1) if (pair := (symbol[i], symbol[i + 1])) in merges]
        heapify(queue)
        while queue:
            _, new, i, (left, right) = heappop(queue)
            j = after[i] if symbol[i] == left else n
            if j >= n or symbol[j] != right:
                continue  # stale
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (pair := (new, symbol[k])) in merges:
                    heappush(queue, (*merges[pair], i, pair))
            if (h := before[i]) >= 0 and (pair := (symbol[h], new)) in merges:
                heappush(queue, (*merges[pair], h, pair))
        return [s for s in symbol if s >= 0]

    def encode(self, text: str) -> bytes:
        out = []
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            at = 0
            while at < len(part):
                cut = CUT.search(part, at + BLOCK) if at + BLOCK < len(part) else None
                end = cut.start() if cut else len(part)
                out.append(b"".join([self[w] for w in self.words.findall(part[at:end] if at or cut else part)]))
                at = end
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        strings, found = self.strings, np.frombuffer(ids, "<u4")
        return b"".join([b"".join([strings[i] for i in found[a:a + BLOCK].tolist()])
                         for a in range(0, len(found), BLOCK)]).decode("utf-8", "replace")


def _model(config) -> Bpe:
    return kept_model("bpe", hash(config.value), lambda: Bpe(config.value))


def read_config(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``ids``: binary, little-endian 32-bit ids of each whole text."""
    config = df.sparkSession.sparkContext.broadcast(read_config(path))  # one vocabulary file
    k = len(keep)

    def task(batch):
        model = _model(config)
        _, offsets = row_bytes(batch.column(k))
        for i, j in slices(offsets):
            texts = batch.column(k).slice(i, j - i).to_pylist()
            yield [*[c.slice(i, j - i) for c in batch.columns[:k]], pa.array([model.encode(t or "") for t in texts], pa.binary())]

    rows = df.select(*keep, df[text_col].cast("string"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:k])
    return over(rows, task, f"{kept}, ids binary")


def decode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``text``: the vocabulary strings of ``ids`` end to end."""
    config = df.sparkSession.sparkContext.broadcast(read_config(path))
    k = len(keep)

    def task(batch):
        model = _model(config)
        _, offsets = row_bytes(batch.column(k))
        for i, j in slices(offsets):
            ids = batch.column(k).slice(i, j - i).to_pylist()
            yield [*[c.slice(i, j - i) for c in batch.columns[:k]], [model.decode(x or b"") for x in ids]]

    rows = df.select(*keep, "ids")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:k])
    return over(rows, task, f"{kept}, text string")
