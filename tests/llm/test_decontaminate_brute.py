"""Operator 4 against edit distances over every segment, templated items included; short items; a hot template in bounded time."""

import random
import time

import numpy as np
import pytest

from marquee.llm import decontaminate as D


def least_edits(part: np.ndarray, text: np.ndarray) -> int:
    """The smallest edit distance of ``part`` to any substring of ``text``."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, c in enumerate(part, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def folded(text: str) -> np.ndarray:
    return D.normal(np.frombuffer(text.encode(), np.uint8))[0]


def brute(items, text):
    out = set()
    for k, (_, item) in enumerate(items):
        whole = np.frombuffer(folded(item).tobytes().strip(b" "), np.uint8)
        size = min(len(whole), D.SEGMENT)
        if size >= D.LEAST:
            out |= {(k, o) for o in range(len(whole) - size + 1) if least_edits(whole[o:o + size], text) <= int(size * D.RATE)}
    return out


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k] = rng.choice(["", "z", out[k] + "y"])
    return "".join(out)


@pytest.mark.parametrize("seed,hot", [(1, 48), (2, 2), (3, 1), (4, 0)])
def test_every_segment_within_its_edits(monkeypatch, seed, hot):
    rng = random.Random(seed)
    monkeypatch.setattr(D, "HOT", hot)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    template = "which of the following statements is true about "
    items = [(k, template + prose(6)) for k in range(6)] + [(k, template + prose(5) + " and why it is so") for k in range(3)]
    items += [(20, prose(25)), (21, prose(30)), (22, items[0][1]), (23, items[0][1][:-1] + "q"), (24, prose(4))]  # equal and nearly equal items
    index = D.Index(items)
    for _, item in items:
        size = min(len(item), 80)
        o = rng.randrange(len(item) - size + 1)
        for n in (0, 2, int(size * D.RATE), int(size * D.RATE) + 3):
            text = folded(prose(rng.randint(0, 12)) + " " + edited(rng, item[o:o + size], n) + " " + prose(rng.randint(0, 12)))
            got = {(k, s) for k, s, *_ in index.find(text)}
            assert got == brute(items, text)
    text = folded(template + prose(3) + ". " + template + prose(4) + ". " + template)
    assert {(k, s) for k, s, *_ in index.find(text)} == brute(items, text)


def test_short_items_match_as_whole_words(spark):
    items = [(1, "Yes!"), (2, "two words"), (3, "Ünï"), (4, "..."), (5, "")]
    rows = [(1, "Oh yes, indeed"), (2, "yesterday"), (3, "has two... WORDS"), (4, "two wordsmiths"), (5, "ünï ünï"), (6, None), (7, "yes")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.matches(docs, bench, least=1).collect()}
    assert got == {(1, 1), (3, 2), (7, 1)}
    assert D.matches(docs, bench).count() == 0 and D.clean(docs, bench).count() == 7
    assert sorted(r.doc_id for r in D.clean(docs, bench, least=5).collect()) == [1, 2, 4, 5, 6, 7]


def test_a_template_of_many_items_stays_cheap():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    template = "which of the following statements is true about "
    items = [(k, (template + " ".join(rng.choice(words) for _ in range(8)))[:78]) for k in range(8000)]
    index = D.Index(items)
    text = folded(" ".join(template + " ".join(rng.choice(words) for _ in range(5)) for _ in range(400)) + " " + items[5][1])
    began = time.process_time()
    assert (5, 0) in {(k, o) for k, o, *_ in index.find(text)}
    assert time.process_time() - began < 20
