"""Operator 1's Levenshtein automata against plain edit distances to every term of the lexicon."""

import random

import pytest

from marquee.llm.toxicity import Lexicon


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_misspelt_is_the_nearest_term(edits):
    rng = random.Random(edits)
    word = lambda n, letters="abcdü": "".join(rng.choice(letters) for _ in range(n))
    terms = {word(rng.randint(3, 10)) for _ in range(80)}
    weights = {t + "$": 1 + rng.random() for t in terms} | {word(4): 2.0 for _ in range(5)}
    lexicon = Lexicon(weights, set(), edits)
    whole = [t for t in terms if len(t) >= 5]
    words = [word(rng.randint(0, 11)) for _ in range(1500)] + sorted(terms)
    for t in whole:  # near the terms
        for _ in range(12):
            w = list(t)
            for _ in range(rng.randint(1, edits + 1)):
                k = rng.randrange(len(w) + 1)
                w[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "x", "ü"])
            words.append("".join(w))
    found = 0
    for w in words:
        near = [(d, -weights[t + "$"]) for t in whole if 1 <= (d := distance(w, t)) <= edits] if len(w) >= 5 else []
        got = lexicon.misspelt(w)
        assert (got is None) == (not near), (w, got, near)
        if got:
            found += 1
            assert (distance(w, got), -weights[got + "$"]) == min(near)
    assert found > 300
