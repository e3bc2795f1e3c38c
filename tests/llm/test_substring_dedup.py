"""Operator 11 against brute force: every window of every text, with the odd cases."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import substring_dedup as S

WORDS = [a + b for a in ("al", "be", "cor", "di") for b in ("ra", "to", "ni")]
SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, length):
    words = [SPLIT.findall((t or "").encode()) for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - length + 1) if i is not None else ():
            key = tuple(w[k:k + length])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - length + 1) if i is not None else ():
            if least[tuple(w[k:k + length])] < i:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def prose(rng, n, sep=" "):
    return sep.join(rng.choice(WORDS) for _ in range(n))


def rows():
    rng = random.Random(3)
    passage, other = prose(rng, 40), prose(rng, 700)
    out = [(None, passage), (5, passage), (4, None), (6, ""), (7, " \t\n "), (8, "one"), (9, prose(rng, 13)), (9, prose(rng, 13))]
    out += [(20 + k, prose(rng, 30) + "  " + passage + "\n" + prose(rng, 9)) for k in range(6)]
    out += [(40, other), (41, other), (41, other), (39, other[:2000]), (42, prose(rng, 5) + " " + other[500:4000] + " end")]
    out += [(50, "ha " * 300), (51, "ha " * 40), (52, "la " + "ha " * 13), (53, "ha " * 12)]
    # a window whose gram's first document holds it in another context
    core = " ".join(f"w{k}" for k in range(5))
    out += [(60, f"{prose(rng, 12)} {core} {prose(rng, 12)}"), *((61 + k, f"{prose(random.Random(1), 12)} {core} {prose(random.Random(2), 12)}") for k in range(3))]
    out += [(70 + k, prose(rng, rng.randint(1, 400))) for k in range(15)] + [(3, "Ünïcödé wörter " * 30), (90, "é  x " * 20), (91, "wörter Ünïcödé " * 20)]
    out += [(100, passage.replace(" ", "\x0b\x0c\r"))]
    return out


@pytest.mark.parametrize("length", [13, 6])
def test_against_brute_force(spark, length):
    given_rows = rows()
    docs = spark.createDataFrame([(i, t, 0, "clash", 1) for i, t in given_rows], "doc_id long, text string, node int, source string, gram int")
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in S.remove_repeats(docs, length).collect()]
    assert sorted(got, key=repr) == brute(given_rows, length)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_text_longer_than_a_slice(spark):
    rng = random.Random(8)
    long = prose(rng, 130_000)  # over half a megabyte, and more words than one piece of anchors
    part = long[300_000:310_000]
    rows = [(1, long), (2, "start " + part + " end"), (3, long[:200_000] + " cut " + long[200_000:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in S.remove_repeats(docs, 13).collect()]
    assert sorted(got, key=repr) == brute(rows, 13)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60), st.lists(st.integers(0, 2), min_size=1, max_size=60), st.integers(2, 6))
def test_parse_covers_every_window(block, text, length):
    block, text = (np.array(x, np.uint64) * np.uint64(2**61) + np.uint64(5) for x in (block, text))
    factors = S.Block(block, length).parse(text)
    held = {block[k:k + length].tobytes() for k in range(len(block) - length + 1)}
    windows = {k for k in range(len(text) - length + 1) if text[k:k + length].tobytes() in held}
    assert {k for a, b in factors for k in range(a, b - length + 1)} == windows
    for a, b in factors:  # longest matches
        whole = [block[k:k + b - a + 1].tobytes() for k in range(len(block) - (b - a))]
        assert b == len(text) or text[a:b + 1].tobytes() not in whole
