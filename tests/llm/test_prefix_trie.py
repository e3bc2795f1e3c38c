"""Operator 13 against brute force over all prefixes, with the odd cases; the trie against a plain one."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import prefix_trie as P


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0, role or "", text or ""), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items())


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, b"clash", 1) for r in rows], "conv_id long, turn long, role string, text string, digest binary, layer int")
    nodes = P.prefix_trie(P.shared_openings(P.turns_of(df)), **sizes).collect()
    least = {bytes(n.key): n.least for n in nodes}
    return sorted((n.least, n.depth, None if n.parent is None else least[bytes(n.parent)], n.n_convs, n.n_children, n.n_leaves, n.saved, n.ends_sha256) for n in nodes)


def some_rows():
    rng = random.Random(5)
    rows = [(None, 0, "user", "no conversation"), (7, None, None, None), (7, 0, "user", ""), (7, 0, "user", ""), (8, 1, "b", "x"), (8, 1, "a", "x"), (8, 1, "a", None)]
    for c in [*range(100, 140), *range(205, 230), 300, 301, 302]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "Ünï", "", "long text " * 20, "hi hi"])))
    rows += [(c, t, "user", f"turn {t}") for c in (400, 401, 402, 403) for t in range(30 + c % 2)]  # long copies
    rows += [(404, t, "user", f"turn {t}" if t < 17 else f"other {t}") for t in range(40)]
    return rows


def test_against_brute_force(spark):
    rows = some_rows()
    assert run(spark, rows) == brute(rebuilt(rows))


def test_layers_and_full_tries(spark):
    rows = some_rows()
    assert run(spark, rows, layer_size=8, limit=20) == brute(rebuilt(rows))


def test_empty_and_turnless(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []
    one = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)  # its base is missing, its only turn goes
    assert run(spark, [(one, 0, "user", "x")]) == brute({one: []})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), min_size=1, max_size=25), st.integers(1, 8))
def test_z_fast_trie(paths, size):
    trie = P.ZFastTrie()
    told = [(P.chain(P.ROOT, [bytes([x]) for x in p], 1000), p, c) for c, p in enumerate(paths)]
    for a in range(0, len(told), size):
        trie.insert_batch(told[a:a + size])
    members = {}
    for keys, _, c in told:
        for d, key in enumerate(keys):
            members.setdefault((key, d), []).append(c)
    got = {(key, d): (n, least) for key, _, d, n, least, _ in trie.expand()}
    assert got == {k: (len(m), min(m)) for k, m in members.items()}
    for node in trie.handles.values():
        assert trie.handles[node.handle()] is node
    for keys, _, _ in told:  # each conversation is found where it ends
        at = trie.locate(keys)
        assert at.end == len(keys) - 1 and at.path[at.end] == keys[-1]


def test_two_fattest():
    for a in range(40):
        for b in range(a + 1, 41):
            assert P.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: (x & -x))
