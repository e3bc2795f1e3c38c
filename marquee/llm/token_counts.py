"""Operator 5: greedy word-piece token counts by a linear longest-match automaton.

Each white-space word, with the mark that starts a word before it, is cut greedily into
the longest vocabulary pieces; only the number of pieces is wanted.  The vocabulary is a
trie.  Every node has a failure link, to where matching goes on once the longest pieces
of its string are taken off, and the count of the tokens so popped; reading a word
follows one edge or link at a time, linear in its letters, and adds counts without
building pieces.  A letter that no piece starts with counts its UTF-8 bytes (the
vocabulary's byte pieces).

One scan without a shuffle; a worker keeps the counts of up to ``CACHE`` words.  Long
texts are read in blocks cut at white space.  Null and empty texts have no words and no
tokens.  Repeated rows count alike.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import over
from marquee.llm.textbytes import row_bytes, slices

MARK = "▁"
CACHE = 1_000_000
BLOCK = 1 << 20
SPACE = re.compile(r"\s")


class Counter(dict):
    """Word -> number of tokens."""

    def __init__(self, pieces: list[str], mark: str = MARK):
        super().__init__()
        self.mark = mark
        self.step: list[dict[str, int]] = [{}]
        value = {0: 0}
        weights = {c: len(c.encode()) for p in pieces for c in p} | {p: 1 for p in pieces if p}
        for piece, weight in weights.items():
            v = 0
            for c in piece:
                if c not in self.step[v]:
                    self.step[v][c] = len(self.step)
                    self.step.append({})
                v = self.step[v][c]
            value[v] = weight
        n = len(self.step)
        self.fail, self.popped = [0] * n, [0] * n
        queue = [0]
        for u in queue:  # breadth first
            for c, v in self.step[u].items():
                queue.append(v)
                if v in value:
                    self.fail[v], self.popped[v] = 0, value[v]
                    continue
                z, count = self.fail[u], self.popped[u]
                while c not in self.step[z]:  # every letter of a piece has an edge from the root
                    count += self.popped[z]
                    z = self.fail[z]
                self.fail[v], self.popped[v] = self.step[z][c], count
        self.rest = [0] * n  # tokens of the node's whole string
        for v in queue[1:]:
            self.rest[v] = self.popped[v] + self.rest[self.fail[v]]

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        count = self[word] = self.count(self.mark + word)
        return count

    def count(self, text: str) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        v = total = 0
        for c in text:
            while (u := step[v].get(c)) is None:
                if v == 0:
                    total += len(c.encode())
                    u = 0
                    break
                total += popped[v]
                v = fail[v]
            v = u
        return total + self.rest[v]

    def text(self, text: str) -> tuple[int, int]:
        words = tokens = at = 0
        while at < len(text):
            cut = SPACE.search(text, at + BLOCK) if at + BLOCK < len(text) else None
            end = cut.start() if cut else len(text)
            part = (text[at:end] if at or cut else text).split()
            words, tokens, at = words + len(part), tokens + sum(map(self.__getitem__, part)), end
        return words, tokens


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without its control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


_COUNTERS: dict[int, Counter] = {}


def count_tokens(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_tokens of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # one vocabulary file
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batch):
        key = hash(tuple(shared.value))
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(shared.value)
        counter = _COUNTERS[key]
        _, offsets = row_bytes(batch.column(1))
        for i, j in slices(offsets):
            got = [counter.text(t or "") for t in batch.column(1).slice(i, j - i).to_pylist()]
            yield [batch.column(0).slice(i, j - i), pa.array([w for w, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())]

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return over(rows, task, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
