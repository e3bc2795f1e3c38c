"""Operator 1: toxicity by a learned lexicon, Levenshtein automata and context windows.

Fitting (on a bounded sample of labelled rows, ``max_rows``): words and word stems that
toxic rows have and others hardly do form the lexicon, which that sample bounds (a caller's
``max_terms`` keeps the heaviest).  Support is counted over distinct passages (a min-hash of word triples), so a text copied a hundred
times is one witness.  The lexicon is a trie.  A word that is not in it is matched by
walking the trie together with the word's Levenshtein automaton (``edits``), so misspelt
terms count too, unless the same spelling stands in clean labelled rows; term and word need
5 letters for that, shorter terms count as spelt (or by a stem).  Each hit's
weight is reduced where its context window reads as a quotation and raised where it
addresses someone; a logistic model of these figures gives the score.

Scoring is one pass without a shuffle over every whole text; long texts are read in
blocks cut at white space.  Null and empty texts score like texts without a hit.
Repeated rows score alike.  Without labelled rows of both kinds the lexicon is empty and
every score 0.  Only the text is an input of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import common
from marquee.llm.common import columns_as, materialize, over
from marquee.llm.textbytes import row_bytes, slices

WORD = re.compile(r"[^\W_]+")
BLOCK = 1 << 20
CACHE = 400_000
STEMS = (3, 4, 5, 6, 7, 8)
WINDOW = 60  # characters to each side of a hit
REPORTS = re.compile(r"\b(said|says|wrote|writes|called|quote[sd]?|quoting|dit|écrit|sagte|schrieb|dijo|escribió)\b")
ADDRESS = re.compile(r"\b(you|your|you're|u|tu|vous|toi|du|dich|dein|ihr|usted|eres)\b")


def blocks(text: str):
    """The text in blocks of about BLOCK letters, cut at white space."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text) and (cut := re.compile(r"\s").search(text, end)):
            end = cut.start()
        else:
            end = len(text)
        yield text[at:end]
        at = end


def terms_of(words: set[str]) -> set[str]:
    """Whole words (ended by $) and their stems."""
    out = {w + "$" for w in words if len(w) > 2}
    for k in STEMS:
        out.update({w[:k] for w in words if len(w) > k})
    return out


def passage_key(text: str) -> int:
    """The smallest hash of the word triples: near copies mostly have the same."""
    words = WORD.findall(text.lower())
    if len(words) < 3:
        return hash_of(" ".join(words))
    return min(hash_of(" ".join(words[k:k + 3])) for k in range(0, len(words) - 2))


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s) >> 1


class Lexicon(dict):
    """Word -> weight of the best term that it has, is, or misspells; 0.0 for most words."""

    def __init__(self, weights: dict[str, float], benign: set[str], edits: int):
        super().__init__()
        self.weights, self.benign, self.edits = weights, benign, edits
        self.stems = {t for t in weights if t[-1] != "$"}
        whole = [t[:-1] for t in weights if t[-1] == "$" and len(t) > 5]
        self.trie: dict = {}
        for t in whole:
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t
        # with one edit, a term's first or second half stays as it is
        self.heads, self.tails = {t[:len(t) // 2] for t in whole}, {t[len(t) // 2:] for t in whole}
        self.head_sizes, self.tail_sizes = sorted({len(h) for h in self.heads}), sorted({len(t) for t in self.tails})
        self.spelled: dict[str, str | None] = {}

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        found = self.exact(word)
        if not found and word not in self.benign and (term := self.misspelt(word)):
            found = 0.7 * self.weights[term + "$"]
        self[word] = found
        return found

    def exact(self, word: str) -> float:
        return max([self.weights.get(word + "$", 0.0), *(self.weights[word[:k]] for k in STEMS if len(word) > k and word[:k] in self.stems)])

    def misspelt(self, word: str) -> str | None:
        """The term within ``edits`` of the word (fewest edits, then heaviest), or None."""
        if self.edits == 1 and not (any(word[:k] in self.heads for k in self.head_sizes) or any(word[-k:] in self.tails for k in self.tail_sizes)):
            return None
        if len(word) < 5:
            return None
        found: list = []
        start = tuple((i, i) for i in range(self.edits + 1))  # states: letters of the word read, edits made
        self._walk(self.trie, start, word, found)
        return min(found, key=lambda x: (x[0], -self.weights[x[1] + "$"]))[1] if found else None

    def _walk(self, node: dict, states: tuple, word: str, found: list) -> None:
        n, k = len(word), self.edits
        for c, child in node.items():
            if c == "":
                cost = min((e + n - i for i, e in states if e + n - i <= k), default=None)
                if cost:
                    found.append((cost, child))
                continue
            best: dict[int, int] = {}
            for i, e in states:
                if i < n and word[i] == c:
                    best[i + 1] = min(best.get(i + 1, k + 1), e)
                if e < k:
                    best[i] = min(best.get(i, k + 1), e + 1)  # the term's letter is missing in the word
                    if i < n:
                        best[i + 1] = min(best.get(i + 1, k + 1), e + 1)  # another letter stands for it
                    for j in range(i + 1, min(n, i + k - e + 1)):  # letters of the word are extra
                        if word[j] == c:
                            best[j + 1] = min(best.get(j + 1, k + 1), e + j - i)
            if best:
                self._walk(child, tuple(best.items()), word, found)

    def figures(self, text: str | None) -> tuple[float, float, float]:
        """Sum and maximum of the weighted hits, and their count's logarithm."""
        total = most = 0.0
        hits = 0
        for part in blocks((text or "").lower()):
            if not any(map(self.__getitem__, words := WORD.findall(part))):
                continue
            del words
            for m in WORD.finditer(part):
                if weight := self[m.group()]:
                    weight *= context(part, m.start(), m.end())
                    total, most, hits = total + weight, max(most, weight), hits + 1
        return min(total, 30.0) / 10, min(most, 10.0) / 5, math.log1p(hits)


def context(text: str, start: int, end: int) -> float:
    """Under 1 in a quotation, over 1 where someone is addressed."""
    left, right = text[max(0, start - WINDOW):start], text[end:end + WINDOW]
    quoted = left.count('"') % 2 == 1 and '"' in right or left.rfind("«") > left.rfind("»") or max(map(left.rfind, "“„")) > left.rfind("”")
    factor = 0.5 if quoted else 1.0
    if quoted and REPORTS.search(left):
        factor *= 0.6
    if not quoted and ADDRESS.search(left[-25:] + " " + right[:25]):
        factor *= 1.2
    return factor


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w)), grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, trains: str, max_rows: int = 20_000, max_terms: int | None = None, support: int = 6,
        precision: float = 0.8, edits: int = 1) -> tuple[Lexicon, np.ndarray] | None:
    """The lexicon and the logistic model, from at most ``max_rows`` labelled rows for which ``trains`` (SQL on doc_id) holds."""
    known = labels.where("toxic is not null and doc_id is not null").where(trains).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").alias("id"), "toxic")
    docs = columns_as(docs, id="doc_id", text="text")
    rows = materialize(docs.join(F.broadcast(sample), "id").select("toxic", F.coalesce("text", F.lit("")).alias("text")), "toxic-sample")

    def witnesses(batch):
        term, key = [], []
        for text in batch.column(0).to_pylist():
            k = passage_key(text)
            found = terms_of(set(WORD.findall(text.lower())))
            term.extend(found)
            key.extend([k] * len(found))
        yield [term, key]

    seen = over(rows.where("toxic = 1").select("text"), witnesses, "term string, passage long").distinct()
    kinds = dict(rows.groupBy("toxic").count().collect())
    if not kinds.get(0) or not kinds.get(1):
        return None

    def clean(batch):
        count: Counter = Counter()
        for text in batch.column(0).to_pylist():
            count.update(terms_of(set(WORD.findall(text.lower()))))
            if len(count) >= CACHE:
                yield [list(count), list(count.values())]
                count.clear()
        yield [list(count), list(count.values())]

    pos = seen.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    neg = over(rows.where("toxic = 0").select("text"), clean, "term string, c long").groupBy("term").agg(F.sum("c").alias("c"))
    passages = seen.agg(F.countDistinct("passage")).first()[0]
    odds = (F.col("n") + .5) / (passages + 1) * (kinds[0] + 1) / (F.col("c") + .5)
    terms = (pos.join(neg, "term", "left").withColumn("c", F.coalesce("c", F.lit(0))).where(F.col("n") >= precision * (F.col("n") + F.col("c")))
             .withColumn("odds", odds).where("odds > 1"))
    if max_terms is not None:
        terms = terms.orderBy(F.desc("odds"), "term").limit(max_terms)
    weights = {r.term: math.log(r.odds) for r in terms.select("term", "odds").collect()}  # bounded by the labelled sample
    if not weights and not pos.limit(1).collect():
        return None
    lexicon = Lexicon(weights, set(), edits)

    def spelled(batch):
        found = set()
        for text in batch.column(0).to_pylist():
            found.update(w for w in set(WORD.findall(text.lower())) if not lexicon.exact(w) and lexicon.misspelt(w))
        yield [list(found)]

    benign = {r.word for r in over(rows.where("toxic = 0").select("text"), spelled, "word string").distinct().collect()}
    lexicon = Lexicon(weights, benign, edits)

    def figures(batch):
        got = [lexicon.figures(t) for t in batch.column(1).to_pylist()]
        yield [batch.column(0), *(list(c) for c in zip(*got))] if got else [batch.column(0), [], [], []]

    table = over(rows.select(F.col("toxic").cast("int").alias("toxic"), "text"), figures, "toxic int, a double, b double, c double").toPandas()  # max_rows rows
    return lexicon, _fit_logistic(table[["a", "b", "c"]].to_numpy(), (table["toxic"] == 1).to_numpy(float))


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray] | None, keep: list[str], text_col: str = "text", below: float | None = None) -> DataFrame:
    """The kept columns and ``score`` (0 to 1) of every row's whole text; with ``below`` only rows of a smaller score,
    chosen within the task.  A kept column named score gives way."""
    keep = [c for c in keep if c != "score"]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias("score")).where(F.lit(True) if below is None else F.col("score") < below)
    k = len(keep)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text_col in keep else [F.col(f"`{text_col}`").alias("scored text")]))
    at = keep.index(text_col) if text_col in keep else k
    lexicon, w = model
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.benign, lexicon.edits))  # bounded by the labelled sample
    key = hash((frozenset(lexicon.weights.items()), frozenset(lexicon.benign)))

    def task(batch):
        own = common.kept("toxicity", key, lambda: Lexicon(*shared.value))
        _, offsets = row_bytes(batch.column(at))
        for i, j in slices(offsets):
            got = np.array([own.figures(t) for t in batch.column(at).slice(i, j - i).to_pylist()])
            scores = 1 / (1 + np.exp(-np.clip(w[0] + got @ w[1:], -30, 30)))
            part = [c.slice(i, j - i) for c in batch.columns[:k]]
            if below is not None:
                chosen = pa.array(scores < below)
                part, scores = [c.filter(chosen) for c in part], scores[scores < below]
            yield [*part, scores]

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:k])
    return over(rows, task, f"{fields}score double")
