"""Operator 7: licence scans by matching statistics over a generalised suffix automaton.

The templates (licence texts and, as short templates, the base phrases) are words; their
generalised suffix automaton has every run of words of every template.  A text's words
are streamed through it: at each word the automaton's state and length give the longest
run of template words that ends there (the matching statistics).  A base phrase stands
where the run that ends there is at least the phrase and its state is the phrase's, or
hangs below it by suffix links.  Long matches (LONG words or more) of one template are
chained in the template's order into covered spans; a template covered by COVER or more
adds its label.

Only words of the templates can be in a match, and only neighbours that are neighbours
in a template can be in one of two words or more, so words are hashed in numpy and
the automaton steps through the runs of such neighbours alone; the rest of a text can't
change a result.  One scan, no shuffle; texts are read in pieces, and memory follows the
number of their words.  Null and empty texts have no words and no labels.  Repeated rows
are scanned alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import over
from marquee.llm.textbytes import row_bytes, word_hashes

INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LONG = 6
COVER = 0.3

#: Openings of public licence texts, by label.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
           "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
           "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
              "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
              "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
           "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
            "License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
           "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
           "following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
           "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or "
           "neighboring rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}
#: The base phrases.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def hashes_of(text: str) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    for _, _, found, _ in word_hashes(raw, np.array([0, len(raw)]), INSIDE):
        return found.tolist()
    return []


@dataclass
class Automaton:
    """Generalised suffix automaton of the templates and phrases."""

    templates: list[tuple[str, list[int]]]
    phrases: list[tuple[str, list[int]]]
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        for _, words in [*self.templates, *self.phrases]:
            last = 0
            for w in words:
                last = self._add(last, w)
        # where each state's runs end in each template
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.size]
        for t, (_, words) in enumerate(self.templates):
            s = 0
            for k, w in enumerate(words):
                s = self.step[s][w]
                up = s
                while up > 0:
                    self.ends[up].append((t, k))
                    up = self.link[up]
        own: dict[int, list[int]] = {}
        for p, (_, words) in enumerate(self.phrases):
            s = 0
            for w in words:
                s = self.step[s][w]
            own.setdefault(s, []).append(p)
        self.at = [own.get(s, []) for s in range(len(self.size))]  # phrases whose state this is
        self.below: list[list[int]] = [[] for _ in self.size]  # phrases of the states above by suffix links
        for s in sorted(range(1, len(self.size)), key=lambda s: self.size[s]):
            up = self.link[s]
            self.below[s] = self.below[up] + self.at[up] if up > 0 else []
        pairs = {(a, b) for _, words in [*self.templates, *self.phrases] for a, b in zip(words, words[1:])}
        words = sorted({w for pair in pairs for w in pair})
        self.words = np.array(words, np.uint64)
        rank = {w: k for k, w in enumerate(words)}
        self.pairs = np.array(sorted(rank[a] * len(words) + rank[b] for a, b in pairs), np.int64)

    def _add(self, last: int, w: int) -> int:
        if w in self.step[last]:
            q = self.step[last][w]
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, w, q)
        cur = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.size.append(size)
        self.step.append(step)
        self.link.append(link)
        return len(self.size) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        new = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = new
            p = self.link[p]
        return new

    def statistics(self, words: list[int]):
        """(state, length) of the longest template run that ends at each word."""
        s = n = 0
        for w in words:
            while s and w not in self.step[s]:
                s = self.link[s]
                n = self.size[s]
            if w in self.step[s]:
                s, n = self.step[s][w], n + 1
            yield s, n

    def runs(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """[start, end) of the maximal runs whose neighbours are all neighbours in a template."""
        if len(hashes) < 2 or not len(self.words):
            return []
        rank = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = self.words[rank] == hashes
        near = np.zeros(len(hashes) + 1, bool)
        code = rank[:-1] * len(self.words) + rank[1:]
        near[1:-1] = known[1:] & known[:-1] & (self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code)
        starts, ends = np.flatnonzero(~near[:-1] & near[1:]), np.flatnonzero(near[:-1] & ~near[1:])
        return [(a, b + 1) for a, b in zip(starts.tolist(), ends.tolist())]

    def scan(self, hashes: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Places (start, phrase), and spans (template, start in it, start in the text, words) of long matches."""
        places, spans = [], []
        for a, b in self.runs(hashes):
            words = hashes[a:b].tolist()
            open_: tuple[int, int] | None = None
            for k, (s, n) in enumerate(self.statistics(words)):
                for p in self.below[s]:
                    places.append((a + k + 1 - len(self.phrases[p][1]), p))
                for p in self.at[s]:
                    if n >= len(self.phrases[p][1]):
                        places.append((a + k + 1 - len(self.phrases[p][1]), p))
                if open_ and n <= open_[1]:  # the match before was maximal
                    spans.extend((t, e - open_[1] + 1, a + k - open_[1], open_[1]) for t, e in self.ends[open_[0]])
                    open_ = None
                if n >= min(LONG, 3):
                    open_ = (s, n)
            if open_:
                spans.extend((t, e - open_[1] + 1, b - open_[1], open_[1]) for t, e in self.ends[open_[0]])
        return places, spans

    def covered(self, spans: list[tuple[int, int, int, int]]) -> dict[str, float]:
        """By label, the best share of a template that a chain of its long matches covers, in the template's and the text's order."""
        best: dict[str, float] = {}
        for t in {s[0] for s in spans}:
            label, words = self.templates[t]
            least = min(LONG, len(words))
            mine = sorted((x, y, n) for u, y, x, n in spans if u == t and n >= least)
            limit = 4 * len(words)  # a chain stays within four template lengths of text
            top: list[tuple[int, int, int, int]] = []  # end in the text, end in the template, words, start in the text
            for x, y, n in mine:
                top = [c for c in top if c[0] >= x - limit]
                got = max((c[2] for c in top if c[0] <= x and c[1] <= y and x - c[3] <= limit), default=0)
                start = next((c[3] for c in top if c[0] <= x and c[1] <= y and x - c[3] <= limit and c[2] == got), x)
                top.append((x + n, y + n, got + n, start))
                share = min(1.0, (got + n) / len(words))
                best[label] = max(best.get(label, 0.0), share)
        return {k: v for k, v in best.items() if v >= COVER}


SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label:string,share:double>>")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and, per row: n_words, n_base, first_word, last_word, base_labels, labels, score, spans (templates covered)."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    auto = Automaton([(k, hashes_of(v)) for k, v in templates.items()], [(v, hashes_of(k)) for k, v in phrases.items()])
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batch):
        data, offsets = row_bytes(batch.column(1))
        for i, j, hashes, at in word_hashes(data, offsets, INSIDE):
            rows = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                places, spans = auto.scan(hashes[a:b])
                share = auto.covered(spans)
                base = {auto.phrases[p][0] for _, p in places}
                starts = [s for s, _ in places]
                score = max([0.0, *share.values(), *([min(1.0, 0.5 + 0.1 * len(places))] if places else [])])
                rows.append((b - a, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                             ",".join(sorted(base | set(share))), score, [{"label": k, "share": v} for k, v in sorted(share.items())]))
            yield [batch.column(0).slice(i, j - i), *(list(c) for c in zip(*rows))]

    out = over(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), task, f"id {kind}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)
