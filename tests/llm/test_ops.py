"""Operators against brute force on small fixtures, with the odd cases of each."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee.llm import decontaminate, license_scan, ngram_join, suffix_dedup, token_counts, topk, toxicity, url_filter, warc
from marquee.plans.components import components

WORDS = [a + b for a in ("al", "be", "cor", "di", "em", "fa", "go", "hu") for b in ("ra", "to", "ni", "mes", "lo", "k")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_texts():
    return ["", None, "one", "two words", "  \n\t ", "Ünïcödé " * 40, "x" * 700, "ab" * 300, "same line here\n" * 60]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = odd_texts()
    base = prose(rng, 120).split()
    for k in range(12):  # near copies of one text, and copies
        own = list(base)
        for _ in range(k // 2):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        out += [" ".join(own), " ".join(own)]
    passage = prose(rng, 60)
    out += [prose(rng, rng.randint(3, 80)) + " " + passage + " " + prose(rng, 30) for _ in range(6)]
    out += [prose(rng, rng.randint(1, 200)) for _ in range(25)]
    return list(enumerate(out)) + [(3, "two words")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0, "clash") for i, t in rows], "doc_id long, text string, lang string, node long, gram string")


def upper_to_lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (5, 5), (20, 21), *[(100, k) for k in range(101, 130)], *[(k, k + 1) for k in range(200, 240)]]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[4] == 1 and got[12] == 10 and got[129] == 100 and got[240] == 200 and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100)])
def test_ngram_components(spark, texts, n, num, den):
    sets, vertices = {}, collections.defaultdict(list)
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", upper_to_lower(t or ""))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = ngram_join.ngram_components(frame(spark, texts), n, num, den).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id)), r
    assert ngram_join.ngram_components(frame(spark, []), n, num, den).collect() == []


def test_ngram_scans(spark, texts, monkeypatch):
    """One sketch a task, whatever its batches; one pass for the prefixes; the hashes of each row as if it were alone."""
    seen, sketched = spark.sparkContext.accumulator(0), []
    prefixes, materialize = ngram_join._prefixes, ngram_join.materialize

    def counted(*args):
        task = prefixes(*args)

        def run(batch):
            seen.add(batch.num_rows)
            yield from task(batch)

        return run

    def kept(df, name):
        out = materialize(df, name)
        if name == "ngram-sets":
            sketched.append(out.where("kind = 1").agg(F.count("*"), F.countDistinct("node"), F.sum("chk")).first())
        return out

    monkeypatch.setattr(ngram_join, "_prefixes", counted)
    monkeypatch.setattr(ngram_join, "materialize", kept)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "5")
    try:
        got = ngram_join.ngram_components(frame(spark, texts).coalesce(1), 4, 85, 100).collect()
    finally:
        spark.conf.set(key, was)
    rows, counters, total = sketched[0]
    assert rows == counters and total == sum(r.n_shingles for r in got)
    assert seen.value == len(texts)
    whole = pa.array([t for _, t in texts])
    alone = [next(ngram_join._each(pa.array([t]), 4)) for _, t in texts]
    assert [x.tolist() for x in ngram_join._each(whole, 4)] == [np.unique(x).tolist() for x in alone]
    bits = [b for flat, at in ngram_join._sets(whole, 4) for b in np.concatenate([*ngram_join._parities(flat, at, rows=7)])]
    shift = np.uint64(64 - ngram_join.PART_BITS)
    for x, b in zip(alone, bits, strict=True):
        assert np.unpackbits(b.view(np.uint8)).tolist() == (np.bincount((x >> shift).astype(int), minlength=64 * ngram_join.WORDS) & 1).tolist()


def removed(texts, length):
    where = collections.Counter()
    raw = [(t or "").encode() for _, t in texts]
    for b in raw:
        where.update(b[k:k + length] for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if where[b[k:k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        out.append(np.cumsum(gone)[:-1] > 0)
    return raw, out


def test_suffix_dedup(spark, texts):
    raw, gone = removed(texts, 200)
    want = collections.Counter()
    for (i, _), b, g in zip(texts, raw, gone):
        kept = np.frombuffer(b, np.uint8)[~g].tobytes()
        want[(i, len(b), int(g.sum()), int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), kept)] += 1
    got = suffix_dedup.remove_repeats(frame(spark, texts), 200).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    whole = suffix_dedup.remove_repeats(frame(spark, texts), 200, as_text=True)
    assert whole.columns == ["doc_id", "text", "lang", "node", "gram", "n_removed"] and whole.count() == len(texts)
    assert suffix_dedup.remove_repeats(frame(spark, []), 200).collect() == []
    none = suffix_dedup.remove_repeats(spark.createDataFrame([(None, "y" * 300), (None, "y" * 300)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in none] == [300, 300]


def test_suffix_dedup_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 1000)
    rng = random.Random(1)
    rows = [(k, prose(rng, 600)) for k in range(3)]
    rows.append((9, rows[0][1][500:2500] + prose(rng, 300)))
    data = np.frombuffer(rows[3][1].encode(), np.uint8)
    whole = suffix_dedup._anchors(data, np.array([0, len(data)]), 200)
    import pyarrow as pa

    for _, _, _, _, got in suffix_dedup._slices(pa.array([rows[3][1]]), 200):
        assert set(got[1].tolist()) == set(whole[1].tolist())  # the same anchors in pieces


def test_decontaminate(spark):
    rng = random.Random(11)
    items = [(k, prose(rng, 40).capitalize() + ".") for k in range(30)] + [(40, ""), (41, None), (42, "short one"), (43, "Tiny"), (None, prose(rng, 30))]
    noisy = list(items[3][1])
    for k in (30, 90, 150):
        noisy[k] = "#" if k % 60 else ""
    rows = [(0, prose(rng, 50) + " " + items[0][1] + " " + prose(rng, 20)), (1, items[1][1].upper()), (2, items[2][1][20:180]), (3, "".join(noisy)),
            (4, prose(rng, 200)), (5, None), (6, ""), (7, "x " + items[4][1]), (7, "x " + items[4][1]), (None, items[5][1]), (8, "short one")]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (7, 4), (None, 5)}
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [4, 5, 6, 8]
    assert decontaminate.clean(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.matches(docs.limit(0), bench).collect() == []


def test_decontaminate_at_every_offset(spark, monkeypatch):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    item, edited = ("".join(rng.choice(letters) for _ in range(200)) for _ in range(2))
    bench = spark.createDataFrame([(0, item), (1, edited)], "item_id long, text string")
    noise = ["".join(rng.choice(letters) for _ in range(150)) for _ in range(121)]
    rows = [(o, noise[o] + item[o:o + 80] + noise[o][::-1]) for o in range(121)]  # 80 bytes word for word
    rows += [(200 + o, noise[o] + item[o:o + 60] + noise[o][::-1]) for o in range(121)]  # too short
    for o in range(0, 121, 7):  # 4 edits
        part = list(edited[o:o + 80])
        part[20], part[40], part[60], part[70] = "#", "", part[60] + "#", "#"
        rows.append((400 + o, noise[o] + "".join(part) + noise[o][::-1]))
    rows += [(600, "clean end"), (601, item[5:115]), (602, "clean start"), (603, item[100:]), (604, "clean")]  # rows end to end
    rows.append((700, noise[0] + item[60:100] + " " + ", " * 700 + item[100:140]))  # one run of punctuation is one space
    want = {(o, 0) for o in range(121)} | {(400 + o, 1) for o in range(0, 121, 7)} | {(601, 0), (603, 0), (700, 0)}
    docs = frame(spark, rows).coalesce(1)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(got) == want
    assert (got[601, 0].first_byte, got[601, 0].last_byte, got[601, 0].least_edits) == (0, 110, 0)
    import pyarrow as pa

    index = decontaminate.Index([(0, item)])
    whole = noise[1] + item[60:100] + " " + ", " * 700 + item[100:140] + noise[2]
    monkeypatch.setattr(decontaminate, "SLICE", 100)  # a long text in pieces
    assert list(decontaminate._rows(pa.array([whole]), index))


def test_align_finds_edits():
    part = b"the quick brown fox jumps over the lazy dog and sleeps"
    assert decontaminate.align(part, b"xx" + part, 2, 0, 10) == (2, 2 + len(part), 0)
    assert decontaminate.align(part, b"xx" + part.replace(b"fox", b"fax"), 2, 0, 10)[2] == 1
    assert decontaminate.align(part, b"xx" + part.replace(b"fox ", b""), 2, 0, 10) is None


def test_token_counts(spark, texts):
    pieces = ["▁a", "▁al", "▁alra", "▁be", "to", "ra", "ni", "a", "b", "mesx", "▁", "corni", "▁cor", "lo", "k", "m", "es", "▁x", "xx", "xxx"]
    longest = max(map(len, pieces))

    def greedy(w):
        n = i = 0
        while i < len(w):
            k = next((k for k in range(min(longest, len(w) - i), 0, -1) if w[i:i + k] in pieces), 0)
            n, i = (n + 1, i + k) if k else (n + len(w[i].encode()), i + 1)
        return n

    counter = token_counts.Counter(pieces)
    rng = random.Random(5)
    for _ in range(3000):
        w = "▁" + "".join(rng.choice("abcxmeslok▁ü") for _ in range(rng.randint(0, 9)))
        assert counter.count(w) == greedy(w), w
    for r in token_counts.count_tokens(frame(spark, texts), pieces).collect():
        w = (dict(texts)[r.doc_id] or "").split()
        assert (r.n_words, r.n_tokens) == (len(w), sum(greedy("▁" + x) for x in w))


def test_license_scan(spark, texts):
    rows = [*texts, (900, "GNU General  Public-License, the Apache license; cc by cc by MIT License"), (901, license_scan.TEMPLATES["mit"].upper()),
            (902, license_scan.TEMPLATES["bsd"][:90]), (903, "gnu general public"), (904, "x cc by gnu general public license")]
    for r in license_scan.scan(frame(spark, rows)).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", upper_to_lower(dict(rows)[r.doc_id] or ""))
        found = [(k, lab) for p, lab in license_scan.PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        places = [k for k, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(found), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({lab for _, lab in found})) and 0 <= r.score <= 1
        if r.doc_id == 901:
            assert r.labels == "mit" and r.score == 1.0
        if r.doc_id == 902:
            assert r.labels == "bsd"


def test_suffix_automaton_statistics():
    rng = random.Random(2)
    for _ in range(60):
        templates = [[rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(3)]
        auto = license_scan.Automaton([(str(k), t) for k, t in enumerate(templates)], [])
        text = [rng.randrange(5) for _ in range(30)]
        runs = {tuple(t[a:b]) for t in templates for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        for e, (_, n) in enumerate(auto.statistics(text)):
            assert n == max([0, *(k for k in range(1, e + 2) if tuple(text[e + 1 - k:e + 1]) in runs)])


def test_topk(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(300)] + [(k, [0.5] * 6) for k in range(300, 420)]
    rows += [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (950, [1.0, 2.0]), (1000, [2.0, 1.0]), (None, [0.1] * 6)]
    df = spark.createDataFrame([(i, v, 1, 1.0) for i, v in rows], "vec_id long, embedding array<float>, pivot int, score double")
    ints = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, a in ints.items():
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints.items() if i != q and len(a) == len(b))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.top_products(df, "vec_id % 50 = 0").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_products(df.limit(0), "vec_id % 50 = 0").collect() == []


def test_topk_stops_early():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-5, 5, (200, 4)) + c for c in (0, 400, -400)])
    blocks = [(k, 0.0, 20.0, np.arange(200) + 200 * k, x[200 * k:200 * k + 200]) for k in range(3)]
    q = x[200:203].copy()
    best, who = topk.search(np.array([200, 201, 202]), q, np.array([[900.0, 5.0, 1500.0]] * 3), float((x * x).sum(1).max()), blocks, 5)
    for r in range(3):
        s = x @ q[r]
        s[200 + r] = -10**9
        assert sorted(best[r], reverse=True) == sorted(s.tolist(), reverse=True)[:5]


def test_url_filter(spark):
    urls = ["http://a.com/x", "HTTP://WWW.Example.COM/en/1?q=/fr/", "http://www.example.com/EN/", "https://example.com/en", "http://b.net/es/1", "http://net/fr/#x",
            "http://xnet/fr/", "http://user@net/fr/", None, "", "nothing", "://", "http://a.com", "http://a.com?x=/", "http://www.example.com/en/\n/x", "http://casino.org/casino/",
            "http://ads-track.example.org/x", "http://c.org/file.exe?x", "ftp://x.com#a/b", "a://b://c.com/"]
    from marquee.llm.op3_url_filter import HOST_RULES, RULES

    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, pattern string")
    for r in url_filter.judge(df, RULES).collect():
        u = r.url or ""
        rest = u.partition("://")[2] if "://" in u else ""
        host, path = re.match(r"([^/?#]*)", rest)[0], ""
        m = re.match(r"[^/?#]*(/[^?#]*)", rest, re.S)
        path = m[1] if m else ""
        host = upper_to_lower(host)
        fits = [(len(rule), v, rule) for v, rule in HOST_RULES
                if (host == rule.partition("/")[0] or host.endswith("." + rule.partition("/")[0])) and path.startswith("/" + rule.partition("/")[2])]
        assert (r.host, r.path) == (host, path), u
        if fits:
            assert (r.rule, r.verdict) == (max(fits)[2], max(fits)[1]), u
        else:
            assert r.verdict in ("allow", "block") and (r.rule is None or r.rank_of < 0)
    assert url_filter.judge(df.limit(0), RULES).collect() == []


def test_url_rules_run_only_as_candidates(spark):
    rules = [url_filter.Rule("r", "block", "foo", ("needle",), 1)]
    df = spark.createDataFrame([(1, "http://a.b/foo"), (2, "http://a.b/foo/needle")], "page_id long, url string")
    assert [(r.page_id, r.verdict) for r in url_filter.judge(df, rules).orderBy("page_id").collect()] == [(1, "allow"), (2, "block")]
    with pytest.raises(ValueError):
        url_filter.judge(df, [url_filter.Rule("x", "block", ".", (), 1)])


def test_warc(spark):
    big = "<p>" + "ä\r\n\r\nWARC/1.1\r\n" * 90
    rows = [(1, "http://a.b/x", big), (5, "http://a.b/x", big), (3, "HTTP://C.d?q", big), (2, None, None), (4, "no scheme", ""), (6, "http://a.b/\r\ny", "small"),
            (7, "http://a.b/z", "small"), (7, "http://a.b/z", "small"), (None, "http://q.r/", "n" * 1200), (9, "http://q.r/", "n" * 1200)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.capture_histories(df).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        origin = max(same) if len(b) >= 1000 else i
        kind = "response" if i == origin else "revisit"
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), kind, origin if kind == "revisit" else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
    order = [(r.url_key, r.captured, r.page_id or -1) for r in got]
    assert order == sorted(order)
    assert warc.capture_histories(df.limit(0)).collect() == []


def test_loser_tree():
    rng = random.Random(8)
    for k in range(0, 9):
        runs = [sorted((rng.randrange(50),) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_warc_damage_is_seen():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert len(list(warc.parse(good * 2))) == 2
    with pytest.raises(ValueError):
        list(warc.parse(good[:-3] + b"x\r\n"))


def toxic_rows():
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(900):
        text = prose(rng, 40).split()
        bad = k % 3 == 0
        if bad:
            for w in rng.sample(["gruntle", "snarfox", "blithor"], 2):
                text.insert(rng.randrange(40), w)
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    docs = frame(spark, rows)
    known = spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known, "crc32(cast(doc_id as string)) % 3 <> 1")
    assert {"gruntle$", "snarfox$", "blithor$"} <= set(model[0].weights)
    extra = [(2000, "halra gruntl snarfix here"), (2001, ""), (2002, None), (2003, "x " * 50), (2004, "GRUNTLE! snarfox?"), (2004, "GRUNTLE! snarfox?")]
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, rows + extra), model, ["doc_id", "lang"]).collect()}
    right = sum((got[k] >= 0.7) == bool(v) for k, v in labels)
    assert right == len(labels)
    assert got[2004] >= 0.7 and got[2000] > got[2003] == got[2001] == got[2002]
    assert toxicity.fit(docs, known.limit(0), "true") is None
    assert {r.score for r in toxicity.score(docs.limit(3), None, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).collect() == []


def test_rare_precise_terms_outlive_common_words(spark):
    rows, labels = toxic_rows()
    rows = [(k, t + " zorgwight" if k % 3 == 0 and k < 60 else t) for k, t in rows]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    for most in (40, None):  # far fewer than the words and stems that toxic rows have
        weights = toxicity.fit(docs, known, "true", max_terms=most)[0].weights
        assert {"gruntle$", "snarfox$", "blithor$", "zorgwight$"} <= set(weights) and min(weights.values()) > 0
    full = weights
    heaviest = sorted(full, key=lambda t: (-full[t], t))[:5]
    assert sorted(toxicity.fit(docs, known, "true", max_terms=5)[0].weights) == sorted(heaviest)


def test_levenshtein_walk():
    lex = toxicity.Lexicon({w + "$": 5.0 for w in ("moronic", "idiot", "scoundrel")}, {"idiom"}, 1)
    assert [lex.misspelt(w) for w in ("idiott", "1diot", "idot", "moronix", "scondrel", "idi", "table")] == ["idiot", "idiot", None, "moronic", "scoundrel", None, None]
    assert lex["idiom"] == 0.0 and 0 < lex["idioz"] < lex["idiot"]
    assert toxicity.Lexicon({"scoundrel$": 5.0}, set(), 2).misspelt("skoundrl") == "scoundrel"


def test_context():
    lex = toxicity.Lexicon({"idiot$": 5.0}, set(), 1)
    plain, quoted, told = (lex.figures(t)[0] for t in ("an idiot here", 'she said "an idiot here" today', "you idiot"))
    assert quoted < plain < told


def test_blocks_cover_text(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 10)
    text = "some words that go on and on, averyveryverylongword end"
    assert "".join(toxicity.blocks(text)) == text


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(9)
    rows, labels = toxic_rows()
    passage = prose(rng, 60)
    bench = [(k, prose(rng, 40)) for k in range(5)]
    clean = [(5000 + k, prose(rng, 90)) for k in range(20)]
    planted = [(6000, clean[0][1] + " end"), (6001, prose(rng, 30) + " " + passage + " " + prose(rng, 30)), (6002, passage + " " + prose(rng, 50)),
               (6003, prose(rng, 40) + " " + bench[2][1]), (6004, ""), (6005, None), (6006, "you gruntle snarfox gruntle")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows + clean + planted], "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(i) for i, c in enumerate(("score", "n_removed", "ids", "encoded", "n_tokens", "id", "node", "column 1", "kept"))}
    docs.withColumns(clash).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert not {k for k, v in labels if v} & set(out) and {k for k, v in labels if not v} <= set(out)
    assert {i for i, _ in clean} <= set(out) and not {6000, 6003, 6006} & set(out)
    assert passage not in out[6001].text and passage not in out[6002].text and out[6001].n_chars == len(out[6001].text)
    assert out[6004].text == "" and out[6005].n_tokens == 0
    for i, t in clean:
        assert out[i].text == t and out[i].n_tokens * 4 == len(out[i].ids)
        assert (out[i].score, out[i].n_removed, out[i].encoded, out[i].id, out[i].node, out[i]["column 1"]) == (0, 1, 3, 5, 6, 7)
