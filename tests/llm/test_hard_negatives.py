"""Operator 12 against brute force, with the odd cases; exact products."""

import random

import numpy as np

from marquee.llm import hard_negatives as H
from marquee.llm import vectors as V


def brute(rows, is_anchor, k=5, n=5, low=80, high=100, scale=256):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x * scale) for x in v):
            continue
        v = [int(np.floor(scale * x)) for x in v]
        best[i] = min(best.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in best.items():
        if not is_anchor(a) or not v:
            continue
        score = {i: min(V.HIGH, max(V.LOW, sum(x * y for x, y in zip(v, w)))) for i, (_, w) in best.items() if i != a and len(w) == len(v)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == label][:k]:
            fits = [i for i in order if best[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fits[:n], 1)]
    return sorted(out)


def run(spark, rows, anchor="vec_id % 4 = 0", **how):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, b"clash", 0) for i, y, v in rows], "vec_id long, embedding array<double>, label int, row binary, width int")
    return sorted(tuple(r) for r in H.hard_negatives(df, anchor, **how).collect())


def some_rows():
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), [rng.gauss(0, 1) for _ in range(6)]) for i in range(160)]
    rows += [(200 + i, i % 3, [0.5] * 6) for i in range(60)]  # one vector many times: ties
    rows += [(300, 0, [0.0] * 6), (304, 1, [0.0] * 6), (308, 5, [1.0] * 6), (309, None, [1.0] * 6), (None, 1, [1.0] * 6), (310, 1, None), (311, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(312, 1, [float("nan")] * 6), (313, 1, [float("inf")] * 6), (320, 1, [1.0, 2.0]), (324, 1, [2.0, 1.0]), (325, 2, [2.0, 0.9]), (326, 1, []), (328, 2, [])]
    rows += [(4, 2, [1.0] * 6), (4, 0, [9.0] * 6), (8, 2, [0.1] * 6), (8, 2, [0.1] * 6)]  # repeated ids
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = some_rows()
    want = brute(rows, lambda i: i % 4 == 0)
    assert len(want) > 200
    assert run(spark, rows) == want
    random.Random(1).shuffle(rows)
    assert run(spark, rows, negatives=2, low=50, high=90) == brute(rows, lambda i: i % 4 == 0, n=2, low=50, high=90)


def test_large_components(spark):
    rng = random.Random(9)
    rows = [(i, i % 2, [rng.choice([1e3, -3e7, 2.5e10, 7e17, 0.1]) * rng.random() for _ in range(4)]) for i in range(24)]
    assert run(spark, rows) == brute(rows, lambda i: i % 4 == 0)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, 1, [1.0, 2.0])]) == []


def test_walk_stops_and_is_exact():
    """Slices of any size give the brute-force best, and bounds spare most of the work on clustered vectors."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16)) * 100
    x = np.floor(np.repeat(centres, 500, axis=0) + rng.normal(size=(4000, 16)) * 3)
    labels = rng.integers(0, 2, 4000)
    near = H.cluster_centres(x[:200:5], 8)
    members = np.arange(0, 4000, 100)
    block = {"ids": members, "labels": labels[members], "centre": (H.units(x[members])[0] @ near.T).argmax(1), "x": x[members], "positives": [], "scores": []}
    best = H.Best(block, 5, None, 0)
    seen = []
    inner = V.products
    H.products, told = lambda a, b: seen.append(len(a) * len(b)) or inner(a, b), H.products
    try:
        for s in range(0, 4000, 1000):
            best.meet(np.arange(s, s + 1000), labels[s:s + 1000], x[s:s + 1000], near)
    finally:
        H.products = told
    for row, a in enumerate(members):
        score = (x @ x[a]).astype(np.int64)
        fits = [i for i in range(4000) if i != a and labels[i] == labels[a]]
        assert best.who[row].tolist() == sorted(fits, key=lambda i: (-score[i], i))[:5]
    assert sum(seen) < 0.5 * len(members) * 4000


def test_products_do_not_wrap():
    for size in (2.0**10, 2.0**30, 2.0**31, 2.0**40, 2.0**62):
        a, b = np.array([[size, -size, 3.0]]), np.array([[size, size, 1.0], [size, -size, 0.0]])
        want = [[max(V.LOW, min(V.HIGH, sum(int(x) * int(y) for x, y in zip(r, c)))) for c in b] for r in a]
        assert V.products(a, b).tolist() == want


def test_topk_takes_every_finite_vector_and_repeats_in_any_order(spark):
    """Operator 2: components of 2**31 and more, and repeated ids, whichever row comes first."""
    from marquee.llm import topk

    rng = random.Random(3)
    rows = [(i, [rng.choice([1.0, -2.0**23, 2.0**31, 3e12, 0.25]) * rng.random() for _ in range(8)]) for i in range(60)]
    rows += [(50, [0.1] * 8), (50, [2.0] * 8), (7, [0.3] * 8), (7, [0.2] * 8), (100, [1e30] * 8), (101, [-1e30] * 8)]
    ints = {}
    for i, v in rows:
        w = [int(np.floor(256 * x)) for x in v]
        ints[i] = min(ints.get(i, w), w)
    want = []
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-min(V.HIGH, max(V.LOW, sum(x * y for x, y in zip(ints[q], w)))), i) for i, w in ints.items() if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, topk.top_products(df, "vec_id % 50 = 0").collect())) == sorted(want)


def test_topk_bound_does_not_wrap():
    from marquee.llm import topk

    x = np.full((3, 64), 2.0**30)
    x[1] = -x[1]
    x[2, 0] = 5.0
    best, who = topk.search(np.array([0]), x[:1], np.array([[0.0]]), float((x * x).sum(1).max()), [(0, 0.0, 1e30, np.arange(3), x)], 2)
    exact = [min(V.HIGH, max(V.LOW, sum(int(a) * int(b) for a, b in zip(x[0], r)))) for r in x]
    assert (best[0].tolist(), who[0].tolist()) == ([exact[2], exact[1]], [2, 1])
