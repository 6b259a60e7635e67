"""Collocations, fingerprints and the prefix trie against plain versions, on odd rows and on blocks far smaller than in use."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailspan.llm import collocations, trie, winnow
from tests.helpers import SMALL, assert_same, duck

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ── 11 ──


def _plain_collocations(rows, least, longest, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in f:
        cands = {g: a for g, a in f[lang].items() if len(g) > 1 and a >= least}
        inside = defaultdict(int)
        for g, a in cands.items():
            for s in range(2, len(g)):
                for i in range(len(g) - s + 1):
                    inside[g[i : i + s]] = max(inside[g[i : i + s]], a)
        rows = []
        for g, a in cands.items():
            cuts = [(1000 * a * n[lang] // (f[lang][g[:k]] * f[lang][g[k:]]), k, f[lang][g[:k]], f[lang][g[k:]]) for k in range(1, len(g))]
            score, _, l, r = min(cuts)
            if not 100 * inside[g] >= 100 * a:
                rows.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrases(spark):
    rng = random.Random(3)
    words = ["ab", "Cd", "É", "x\xa0y", "中", "#1", "the", "of"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) + rng.choice([".", ",", "!\n", "  \t", "\x0b", "; "]) + " the of  the", rng.choice(["en", None, "de"])) for _ in range(120)]
    rows += [(None, "en"), ("", "en"), (" \t\n", None), ("The of the " * 3000, "en"), ("same words here", "fr"), ("same words here", "fr"), ("y" * 90_000, "de")]
    return rows


@pytest.mark.parametrize("least,top", [(3, 2000), (20, 5)])
def test_collocations(spark, phrases, least, top):
    df = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(phrases)], DOCS).withColumns({c: F.lit(1) for c in ("piece", "m", "gram", "c", "k", "w", "_text")})
    got = [tuple(r) for r in collocations.collocations(df, least=least, top=top).collect()]
    assert got and sorted(got) == _plain_collocations(phrases, least, 5, top)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_grams_under_any_bitmap(n):
    """A bitmap with all bits, as if everything collided, leaves exact counts of all n-grams; an empty one leaves none."""
    rng = random.Random(n)
    rows = Counter((rng.choice(["en", "de"]), " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))) for _ in range(300))
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([p for _, p in rows]), pa.array(list(rows.values()), pa.int64())], names=["lang", "piece", "m"])
    want = Counter()
    for (lang, piece), m in rows.items():
        w = piece.split(" ")
        for i in range(len(w) - n + 1):
            want[lang, " ".join(w[i : i + n])] += m
    size = (1 << collocations.SLOT_BITS) >> 3
    for bits, told in ((np.full(size, 255, np.uint8), want), (np.zeros(size, np.uint8), want if n == 1 else {})):
        got = pa.Table.from_batches(list(collocations.counted(collocations.grams(iter([batch, batch.slice(0, 0)]), n, bits))), collocations._COUNTS).to_pylist()
        assert {(r["lang"], r["gram"]): r["c"] for r in got} == dict(told)
    least = list(collocations.counted(collocations.grams(iter([batch]), n, np.full(size, 255, np.uint8)), 5))
    assert {(r["lang"], r["gram"]) for b in least for r in b.to_pylist()} == {k for k, c in want.items() if c >= 5}


def test_collocations_of_nothing(spark, phrases):
    none = spark.createDataFrame([], DOCS)
    assert collocations.collocations(none).isEmpty()
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None)], DOCS)).isEmpty()


def test_scores_beyond_64_bits(spark):
    many = spark.createDataFrame([("en", "a b", 4_000_000_000_000), ("en", "a", 3), ("en", "c", 5_000_000_000_000)], "lang string, piece string, m long")
    got = {(r.gram): r.c for r in collocations.frequent_phrases(many).collect()}
    assert got == {"a b": 4_000_000_000_000, "b": 4_000_000_000_000, "a": 4_000_000_000_003, "c": 5_000_000_000_000}


# ── 12 ──


def _plain_print(text, k, w):
    c = [ord(x) for x in text]
    k = min(k, len(c))
    hashes = []
    for i in range(len(c) - k + 1 if c else 0):
        h = 0
        for x in c[i : i + k]:
            h = (h * winnow.BASE + x + 1) % 2**64
        h ^= h >> 30
        h = h * winnow.MIX[0] % 2**64
        h ^= h >> 27
        h = h * winnow.MIX[1] % 2**64
        hashes.append(h ^ (h >> 31))
    w, at = min(w, len(hashes)), set()
    for i in range(len(hashes) - w + 1 if hashes else 0):
        low = min(hashes[i : i + w])
        at.add(max(j for j in range(i, i + w) if hashes[j] == low))
    return [(hashes[j], j) for j in sorted(at)]


def _alike(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def _odd_documents():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abc é中😀\n") for _ in range(n))
    rows = [(i, text(rng.randrange(0, 120))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "a"), (203, "a" * 500), (204, "a" * 500), (205, text(4000)), (None, "no id " * 5), (None, None), (300, "twice " * 9), (300, "twice " * 9), (300, "a third text of this id")]
    return rows


@pytest.mark.parametrize("k,w,stretch", [(16, 31, 8192), (4, 5, 4), (1, 1, 1)])
def test_fingerprints(spark, k, w, stretch):
    rows = _odd_documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("s", "p", "guest", "n_chars", "_text")})
    got = sorted(map(tuple, winnow.edited_with_next(df, k=k, w=w, stretch_rows=stretch).collect()), key=str)
    # descending by id, equal ids by text, null ids last
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    want = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (_plain_print(x, k, w) for x in (text, edited, after))
        told = lambda f: ",".join(f"{h:016x}:{p}" for h, p in f)
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), told(a), told(b), _alike(a, b), _alike(a, c)))
    assert got == sorted(want, key=str)
    plain = {(r.doc_id, r.n_chars): list(zip(r.hashes, r.positions, strict=True)) for r in winnow.fingerprints(df.filter("doc_id < 200"), k=k, w=w).collect()}
    for doc, text in rows:
        if doc is not None and doc < 200:
            assert [(h % 2**64, p) for h, p in plain[doc, len(text)]] == _plain_print(text, k, w)


def test_fingerprints_of_few(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert winnow.edited_with_next(none).isEmpty() and winnow.fingerprints(none).isEmpty()
    (one,) = winnow.edited_with_next(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0


def test_shared_passages_share_a_hash():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(200):
        passage = text(winnow.GRAM + winnow.WINDOW - 1)
        a, b = (winnow.fingerprint(text(rng.randrange(200)) + passage + text(rng.randrange(200))) for _ in range(2))
        assert len(np.intersect1d(a[0], b[0]))


def test_op12_edits_keep_half(spark):
    rows = winnow.op12_fingerprints(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    long = [r for r in rows if r.n_chars > 500 and r.near_next < 0.5]
    assert long and sum(0.2 < r.near_edited < 0.8 for r in long) > 0.95 * len(long)


# ── 13 ──


def _plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, role, hashlib.md5(text.encode()).digest()), role, text))
    told = {c: [(r, t) for _, r, t in sorted(x, key=lambda y: y[0])] for c, x in own.items()}
    full = {}
    for c, x in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = told.get(c - c % 100, [])[:h] + x[h:]
    members = defaultdict(list)
    for c, x in full.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        leaves, saved = int(not kids[node]), (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for k in kids[node]:
            leaves, saved = leaves + sums[k][0], saved + sums[k][1]
        sums[node] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[node]) if len(full[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def _conversations(seed, n=260, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(900), n):
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]) if t > 2 else "user", rng.choice(["hi", "hello there", "", None, "é😀"]) if t > 1 else "start") for t in range(rng.randrange(1, longest))]
    rows += [(5, t, "user", f"turn {t % 3}") for t in range(300)] + [(5, 7, "user", "again")] * 4
    rows += [(None, 1, "user", "x"), (None, None, None, None), (-7, 1, "user", "start"), (10**15 + 1, 3, "user", "start"), (10**15 + 1, None, "user", "y" * 50_000)]
    return rows + [(c, 0, "user", "start") for c in range(2000, 2080)]


@pytest.mark.parametrize("seed,block,ids", [(1, 1024, 12), (2, 3, 2), (3, 1, 0)])
def test_trie(spark, seed, block, ids, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "IDS", ids)
    rows = _conversations(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("pos", "depth", "block", "conv", "len", "x", "_i")}).repartition(3)
    got = sorted(map(tuple, trie.conversation_trie(df).collect()), key=lambda r: (r[0], r[1]))
    assert got == _plain_trie(rows)


def test_deep_lights(spark):
    """A path that changes its smallest conversation at each step, and lights upon lights."""
    rows = [(1000 + c, t, "user", str(t) if t <= c else f"own {c}") for c in range(40) for t in range(c + 2)]
    rows += [(5000 + i, t, "user", format(i, "06b")[t]) for i in range(64) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, trie.conversation_trie(df).collect()), key=lambda r: (r[0], r[1])) == _plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")).isEmpty()


# ── SQL ──


@pytest.mark.parametrize("m,name", [(collocations, "op11_collocations"), (trie, "op13_prefix_trie")])
def test_sql(spark, m, name):
    assert_same(m.QUERIES[name](spark, SMALL).toPandas(), duck(SMALL).execute(m.ORACLE_SQL[name]).df())
