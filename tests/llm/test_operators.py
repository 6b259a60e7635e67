"""The operators against plain versions, on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailspan.llm import ann, jaccard, langid, lines, mixing, packing, pii, quality, registry, sharding, warc
from mailspan.llm._graph import components
from tests.helpers import SMALL, assert_same, duck

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _texts(n: int = 60, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    return ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(6, 15))) for _ in range(rng.randrange(2, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every awkward case, and columns named like those that operators use inside."""
    texts = _texts()
    near = texts[0].split(" ")
    near[5] = "changed"
    rows = [(i, t, "en", "s" if i % 3 else None, len(t)) for i, t in enumerate(texts)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, " \n\t ", "en", "s", 3), (103, texts[0], "en", "s", 1), (104, texts[0], "en", "s", 1), (105, " ".join(near), "en", "s", 1)]
    rows += [(106, "x " * 40_000, "en", "s", 1), (107, "word " * 3, "en", "t", 1), (108, "y" * 90_000, "en", "t", 1), (103, texts[0], "en", "s", 1), (None, texts[1], "en", "t", 1), (109, "é ü 中文 😀 " * 20, "zh", "u", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("kept", "k", "t", "block", "epoch", "shard", "pii", "gone", "component", "_text", "_d", "_h", "_s", "_e")})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# ── 1 ──


def test_sharding(odd, none):
    rows = sharding.shard_by_bytes(odd, "doc_id", "text").collect()
    assert len(rows) == odd.count() and sharding.shard_by_bytes(none, "doc_id", "text").isEmpty()
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for s, own in by.items():
        assert 0 <= s < 8 and sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) <= largest
    told = {(r.doc_id, r.text): r for r in odd.collect()}
    for (i, t) in told:
        assert any(r.doc_id == i and r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode()) for r in rows)


def test_hot_text_is_spread(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i} of its own") for i in range(3000)], "doc_id long, text string")
    got = [r["b"] for r in sharding.shard_by_bytes(df, "doc_id", "text").groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(got) == 8 and max(got) - min(got) < 60


# ── 2 ──


def _plain_bayes(train, texts):
    counts, docs = defaultdict(Counter), Counter()
    for t, lang in train:
        b = langid.buckets(t)
        if b is not None:
            counts[lang].update(b.tolist())
            docs[lang] += 1
    out = []
    for t in texts:
        b = langid.buckets(t)
        if b is None:
            out.append("und")
            continue
        score = {}
        for lang in counts:
            total = sum(counts[lang].values()) + langid.ALPHA * langid.BUCKETS
            score[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang][x] + langid.ALPHA) / total) for x in b.tolist())
        out.append(max(sorted(score), key=score.get))
    return out


def test_language(spark, odd, none):
    train = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chien et le chat", "fr"), ("the house of the man", "en"), ("", "en"), (None, "de"), ("x", None)]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    texts = ["the man and the cat", "die katze", "et le chat", None, "", "123 !?", "Der Mann", "THE DOG" * 500]
    got = [r.lang_pred for r in langid.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()]
    assert got == _plain_bayes([x for x in train if x[0] and x[1]], texts)
    assert langid.predict(none, model).isEmpty()
    empty = langid.fit(none)
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.predict(odd, model).count() == odd.count()


def test_language_held_out(spark):
    got = langid.op2_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


# ── 3 ──


def test_warc_round_trip(spark, odd, tmp_path):
    pages = odd.select("doc_id", "source", "text", "kept")
    warc.write_warc(pages, str(tmp_path / "w"), "doc_id", "source", "text")
    rows = warc.read_warc(spark, str(tmp_path / "w")).collect()
    source = pages.collect()
    assert len(rows) == len(source) and not any(r.error for r in rows)
    first = {}
    for r in source:
        if r.doc_id is not None:
            first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    texts = defaultdict(set)
    for r in source:
        texts[r.doc_id].add(r.text or "")
    for r in rows:
        i = None if r.id is None else int(r.id)
        if r.record_type == "response":
            assert bytes(r.payload).decode() in texts[i]
            assert r.digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
            assert i is None or first[bytes(r.payload).decode()] == i
        else:
            assert r.payload == b"" and int(r.refers_to) in first.values() and (i is None or int(r.refers_to) < i)


def test_warc_broken_segments(spark, tmp_path):
    long = "".join(random.Random(1).choice("abc\r\n") for _ in range(50_000))
    df = spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"), "page_id", "url", "html")
    assert bytes(warc.read_warc(spark, str(tmp_path / "w")).first().payload).decode() == long
    (part,) = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-") and p.stat().st_size > 100]
    import gzip

    records = re.split(rb"(?=WARC/1\.1\r\n)", gzip.decompress(part.read_bytes()))[1:]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "part-0").write_bytes(b"".join(reversed(records)))  # any order is fine
    assert bytes(warc.read_warc(spark, str(tmp_path / "x")).first().payload).decode() == long
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "part-0").write_bytes(b"".join(records[:1] + records[2:]))
    assert "missing" in warc.read_warc(spark, str(tmp_path / "y")).first().error
    with pytest.raises(ValueError):
        warc.dechunk(b"3\r\nabcd\r\n0\r\n\r\n")


def test_warc_nothing(spark, none, tmp_path):
    warc.write_warc(none, str(tmp_path / "w"), "doc_id", "source", "text")
    assert warc.read_warc(spark, str(tmp_path / "w")).isEmpty()


# ── 4 ──


def _plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + o for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for o in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered)


def test_quality(spark, odd, none):
    more = spark.createDataFrame([(1, "a b c d e f g h " * 3 + "x\x1cy \x85 z", "", "", 1), (2, "# * one\none\none", "", "", 1)], DOCS)
    df = odd.select("doc_id", "text", "kept", "k").unionByName(more.select("doc_id", "text", F.lit(1).alias("kept"), F.lit(1).alias("k")))
    for r in quality.cascade(df, measures=True).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _plain_measures(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.rejected_by is None) and (not r.base_failed or not r.kept)
    assert quality.cascade(none).isEmpty()
    order = [x["rule"] for x in quality.rule_order(odd)]
    assert sorted(order) == sorted(quality.RULES)
    a = {(r.doc_id, r.text): r.kept for r in quality.cascade(odd, order=order).collect()}
    assert a == {(r.doc_id, r.text): r.kept for r in quality.cascade(odd, order=order[::-1]).collect()}


# ── 5 ──

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            if kind == "ip":
                fine = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                fine = 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
            else:
                fine = kind == "email" or 9 <= len(digits) <= 15
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_like_the_patterns():
    rng = random.Random(2)
    cases = ["".join(rng.choice("a.@-+1 29(0)5%ü") for _ in range(rng.randrange(60))) for _ in range(20_000)]
    cases += ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "x@y", "4111 1111 1111 1111", "+1 (269) 555-3296", "256.1.1.1 001.2.3.4", None, "", "@", "a@@b.c"]
    for t in cases:
        assert pii.base_spans(t) == _plain_spans(t), t


def test_pii(spark, odd, none):
    rows = [(i, f"word number {i} password=b7db7aa4a5fcc783{i:02d} and mail a{i}@b.com and call +1 (269) 555-32{i:02d} or 4111 1111 1111 1111 from 10.0.0.{i}") for i in range(40)]
    rows += [(100 + i, f"nothing at all here number {i} of the house at rest.") for i in range(40)] + [(200, None), (201, ""), (202, "1" * 150_000), (203, "a" * 150_000 + "@")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pii", F.lit(1))
    got = {r.doc_id: r for r in pii.find(df, pii.train(df)).collect()}
    for r in got.values():
        base = [(s.kind, s.start, s.end) for s in r.pii if s.kind in pii.BASE]
        assert base == _plain_spans(r.text) if r.doc_id < 202 else base == []
    assert all({s.kind for s in got[i].pii} == {"email", "phone", "card", "ip", "secret"} for i in range(40))
    assert all(not got[i].pii for i in range(100, 140))
    assert pii.find(none, pii.train(none)).isEmpty() and pii.find(odd, pii.train(odd)).count() == odd.count()


# ── 6 ──


def test_mixing_plan():
    t = {"a": 9000, "b": 500, "c": 500, None: 0}
    w = mixing.weights({k: v for k, v in t.items() if v}, e := mixing.exponent({k: v for k, v in t.items() if v}, repeats=100))
    assert abs(sum(w.values()) - 1) < 1e-12 and abs(-sum(x * math.log(x) for x in w.values()) - 0.9 * math.log(3)) < 1e-4 and 0 < e < 1
    plan = mixing.plan(t)
    assert all(b >= t[k] for k, (_, b) in plan.items()) and max(b / t[k] for k, (_, b) in plan.items() if t[k]) <= 4.01 and plan[None] == (0.0, 0)
    assert mixing.exponent({"a": 5}) == 1.0


def test_mixing(odd, none):
    rows = mixing.mixed(odd, target=0.99).collect()
    tokens = Counter()
    for r in odd.collect():
        tokens[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    plan = mixing.plan(dict(tokens), 0.99)
    shown = Counter()
    for r in rows:
        shown[r.source] += r.tokens
    assert all(shown[k] <= max(b, tokens[k]) for k, (_, b) in plan.items())
    first = [r for r in rows if r.epoch == 0]
    assert len(first) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.source, r.epoch].append((r.token_start, r.tokens))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    assert mixing.mixed(none).isEmpty()


def test_plans_of_sources_by_spark(spark):
    rng = random.Random(8)
    for tokens, budget in (({"a": 5}, None), ({"a": 900, "b": 30, None: 2, "zero": 0}, None), ({f"s{i}": int(1.5 ** rng.randrange(30)) for i in range(3000)}, None), ({"a": 10, "b": 1000}, 777), ({"zero": 0}, None)):
        got = mixing.planned(spark.createDataFrame([(k, t) for k, t in tokens.items()], "s string, t long"), budget=budget).collect()
        plan = mixing.plan(tokens, budget=budget)
        for r in got:
            full, rest = divmod(plan[r.s][1], r.t) if r.t else (1, 0)
            assert (r.full, r.rest, r.epochs) == (full, rest, full + (rest > 0)), (r, plan[r.s])


# ── 7 ──


def _brute(rows, k=10):
    out = {}
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for q, v in ok:
        if q % 100 == 0:
            out[q] = sorted((math.sqrt(((v - w) ** 2).sum()), i) for i, w in ok if i != q)[:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[0][1]) for i in range(30)] + [(3000, None), (3100, []), (3200, [0.0] * 8), (3300, [1.0] * 7 + [float("nan")]), (3400, [1.0] * 7 + [None]), (None, rows[1][1]), rows[7], (3500, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "code": F.lit(2), "rank": F.lit(3)})
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id, r.rank))
    want = _brute([r for r in rows[:-2] if r[0] != 3500])
    assert set(got) == set(want)
    hits = 0
    for q, own in got.items():
        assert [x[2] for x in own] == list(range(1, 11)) and own == sorted(own)
        hits += len({x[1] for x in own} & {i for _, i in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    assert [x[1] for x in got[0]] == list(range(2000, 2010))
    assert ann.nearest(df.limit(0)).isEmpty() and ann.nearest(df.filter("vec_id in (100, 101)")).count() == 1


def test_double_vectors_are_ranked_as_they_are(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (1 + 1e-9 * rng.normal(size=4)).tolist()) for i in range(300)] + [(400, [1e300, 0.0, 0.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = _brute(rows)
    assert all(r.score == want[r.query_id][r["rank"] - 1][0] and r.vec_id == want[r.query_id][r["rank"] - 1][1] for r in got if r.query_id < 400) and len(got) == 40


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want, got = _brute(rows), defaultdict(set)
    for r in ann.op7_nearest_neighbours(spark, d).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_recall_among_near_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 16))
    x[1000:4000] = x[0] + 1e-4 * rng.normal(size=(3000, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    want, got = _brute(rows), defaultdict(set)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got[r.query_id].add(r.vec_id)
    hits = {q: len(got[q] & {i for _, i in w}) for q, w in want.items()}
    near, others = [hits[q] for q in hits if 1000 <= q < 4000], [hits[q] for q in hits if not 1000 <= q < 4000]
    print("RECALL", sum(near), 10 * len(near), sum(others), 10 * len(others))
    assert sum(near) >= 0.95 * 10 * len(near) and sum(others) >= 0.9 * 10 * len(others)


def test_beams_never_do_worse():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 16)).astype(np.float32)
    books = np.stack([ann._kmeans(x * s, 16, rng) for s in (1.0, 0.5, 0.3)])
    error = lambda b: ((x - sum(books[m][ann.encode(x, books, b)[0][:, m]] for m in range(3))) ** 2).sum()
    codes, norms = ann.encode(x, books, 4)
    assert error(4) <= error(1)
    assert np.allclose(norms, (sum(books[m][codes[:, m]] for m in range(3)) ** 2).sum(1), rtol=1e-3)


# ── 8 ──


def test_packing(odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack_documents(odd).collect()
    want = Counter()
    for r in odd.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        at, size, piece = 0, (len(ids) - 1) % 1024 + 1, 0
        while at < len(ids):
            want[r.doc_id, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())] += 1
            at, size, piece = at + size, 1024, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 1024
    assert packing.pack_documents(none).isEmpty()


def test_best_fit_like_a_plain_one():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 100) for _ in range(3000)]
    bins, places = packing.best_fit(lengths, 100, 16)
    open_, n, out = [], 0, []
    for x in lengths:
        fits = [b for b in open_ if b[1] >= x]
        if fits:
            b = min(fits, key=lambda b: b[1])
        else:
            if len(open_) == 16:
                open_.remove(min(open_, key=lambda b: b[1]))
            b = [n, 100]
            n += 1
            open_.append(b)
        out.append(100 - b[1])
        b[1] -= x
        if not b[1]:
            open_.remove(b)
    assert max(bins) + 1 == n and len(places) == len(out)


@pytest.mark.parametrize("text", ["", " ", "a  b\n\n c", "it's   \t 12,3\xa0x　y", "don’t 😀😀 中文 \x1c\x1d a", "<|endoftext|> x", "\r\n\r\n\x85 z ", "a​b _x_ 1²3"])
def test_ids_like_the_tokenizer(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    assert np.frombuffer(packing.Ids(path).of(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


# ── 9 ──


def _sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _plain_components(rows):
    sets = [_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i][0])
    return [(rows[i][0], len(sets[i]), min((x for x in groups[top(i)] if x is not None), default=None) if sets[i] else rows[i][0]) for i in range(len(rows))]


def test_jaccard(spark, odd, none):
    rng, texts = random.Random(4), _texts(40, 9)
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(400):  # copies with more and more edits, over all sizes
        words = rng.choice(rows[: 40 + i])[1].split(" ")
        words = words[rng.randrange(2) :] * rng.choice((1, 1, 1, 2))
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate(range(1, 40))] + [(3000, "W0 w1 W2"), (3001, "w0 w1"), (3002, "w0\tw1\nw2")]
    rows += [(r.doc_id, r.text) for r in odd.filter("doc_id >= 100 or doc_id is null").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"set_key": F.lit(1), "n_shingles": F.lit(2)})
    key = lambda x: tuple(-1 if y is None else y for y in x)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=key)
    assert got == sorted(_plain_components(rows), key=key)
    assert jaccard.near_duplicates(none).isEmpty()


def test_jaccard_of_short_texts_alone(spark):
    rows = [(3, "a b c"), (1, "A  b c"), (2, "x y z"), (4, ""), (5, None), (6, "a b c d e f")]
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 0, 4), (5, 0, 5), (6, 2, 6)]


def test_jaccard_stars_of_many_sets():
    n = 60_000
    c = np.arange(n, dtype=np.int32)
    src, dst = jaccard.stars((c // 2).astype(np.uint64) << np.uint64(1), c, n)
    assert src.tolist() == list(range(0, n, 2)) and dst.tolist() == list(range(1, n, 2))


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(5)
    starts = jaccard.band_starts(2000)
    for common in (np.zeros(0, np.uint64),) * 2:
        for _ in range(1500):
            a = int(rng.integers(1, 1200))
            base = np.unique(rng.integers(0, 1 << 63, a, dtype=np.uint64))
            drop = int(rng.integers(0, len(base) // 4 + 1))
            add = rng.integers(0, 1 << 63, int(rng.integers(0, len(base) // 6 + 1)), dtype=np.uint64)
            x, y = base, np.unique(np.concatenate((base[drop:], add)))
            both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
            common = np.sort(rng.choice(base, len(base) // 3, replace=False)) if rng.random() < 0.5 else common
            if 100 * both >= 75 * union and (len(x) != len(y) or both != len(x)):
                for drops in (None, np.asarray(common % 3 + 1, np.uint8)):  # at one level, and at several
                    for salts in (1, 3):
                        met, guests = [set(), set()], [set(), set()]
                        for i, z in enumerate((x, y)):
                            k, _, guest = jaccard.batch_keys([z], starts, common, drops, salts)
                            met[i], guests[i] = set(k.tolist()), set(k[guest == 1].tolist())
                        assert met[0] & met[1] - (guests[0] & guests[1])
                m = min(len(jaccard.sketch(x)), len(jaccard.sketch(y))) // 8
                distance = int(np.bitwise_count(jaccard._folded(jaccard.sketch(x), m) ^ jaccard._folded(jaccard.sketch(y), m)).sum())
                assert distance <= len(np.setxor1d(x, y)) <= jaccard.bound(len(x), len(y))


def test_keys_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 5, 6, 7, 30, 31, 400, 2000)]
    starts, common = jaccard.band_starts(3000), np.sort(np.concatenate([x[::2] for x in sets]))
    drops = np.asarray(common % 4 + 1, np.uint8)
    k, o, _ = jaccard.batch_keys(sets, starts, common, drops, 2)
    for i, s in enumerate(sets):
        assert sorted(k[o == i].tolist()) == sorted(jaccard.keys_of(s, starts, common, drops, 2).tolist())


def test_large_groups_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    monkeypatch.setattr(jaccard, "SPLIT_ROWS", 20)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if rng.random() > 0.02 else f"e{rng.randrange(9999)}" for w in base)) for i in range(150)]
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(_plain_components(rows))


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}


# ── 10 ──


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _norm(line):
    return re.sub(r"[^\w]+|_+", " ", line.lower()).strip()


def _plain_lines(rows, same=None):
    """Document -> its text without repeated lines, by edit similarity alone, or by `same` (normalised line -> group)."""
    found = {}
    for i, t in rows:
        for pos, line in enumerate((t or "").split("\n")):
            norm = _norm(line)
            if len(norm.split()) >= lines.LEAST_WORDS or len(norm) >= lines.LEAST_CHARS:
                found.setdefault(norm, []).append((i, pos))
    norms = sorted(found)
    root = list(range(len(norms)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(norms)):
        for j in range(i):
            a, b = norms[i], norms[j]
            if same[a] == same[b] if same else 10 * abs(len(a) - len(b)) <= max(len(a), len(b)) and 10 * _edit(a, b) <= max(len(a), len(b)):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, n in enumerate(norms):
        groups[top(i)] += found[n]
    gone = set()
    for places in groups.values():
        gone |= set(places) - {min(places)}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


def _groups_of(spark, rows):
    """Normalised line -> the group that the operator puts it in."""
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    docs = df.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "text")
    found = lines.hashed_lines(docs)
    label = {r.node: r.component for r in lines.similar_lines(docs, lines.written(found)).collect()}
    texts = {(r.doc_id, p): _norm(x) for r in df.collect() for p, x in enumerate((r.text or "").split("\n"))}
    return {texts[r.doc_id, r.pos]: label.get(r.h1, r.h1) for r in found.select("doc_id", "pos", "h1").collect()}


def test_lines(spark, odd, none):
    rng, texts = random.Random(8), _texts(30, 12)
    pool = [x for t in texts for x in t.split("\n")]
    rows = []
    for i in range(80):
        own = []
        for _ in range(rng.randrange(1, 7)):
            line = rng.choice(pool)
            if rng.random() < 0.4:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyz") + line[at + 1 :]
            own.append(rng.choice((line, line.upper(), f"  {line}!", "", "short line")))
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h1": F.lit(1), "n_removed": F.lit(2), "keeper": F.lit(3)})
    got = lines.dedup_lines(df)
    assert set(got.columns) == set(df.columns)
    got = {r.doc_id: r.text for r in got.collect()}
    label = _groups_of(spark, rows)
    assert got == _plain_lines(rows, label)
    # of what edit similarity alone would take out of these short lines with typos, at least eight tenths go, and nothing else
    want, kept = _plain_lines(rows), lambda t: Counter((t or "").split("\n"))
    left = [sum((kept(got[i]) - kept(want[i])).values()) for i in got]
    assert all(not kept(want[i]) - kept(got[i]) for i in got if want[i]) and sum(left) <= 0.2 * sum(sum((kept(t) - kept(want[i])).values()) for i, t in rows if t)
    assert lines.dedup_lines(none).isEmpty() and lines.dedup_lines(odd).count() == odd.count()


def test_piecewise_edits(spark):
    rng = random.Random(9)
    rows = []
    for n in (0, 5, 100, 1024, 3000):
        a = "".join(rng.choice("abcd ") for _ in range(n))
        b = "".join(c if rng.random() > 0.03 else "z" for c in a)
        rows.append((a, b))
    got = [r.d for r in spark.createDataFrame(rows, "x string, y string").select(F.expr(lines.edits("x", "y")).alias("d")).collect()]
    assert all(d >= _edit(a, b) for d, (a, b) in zip(got, rows)) and all(d == _edit(a, b) for d, (a, b) in zip(got, rows) if len(a) <= lines.PIECE and _edit(a, b) <= 0.1 * len(a))


def test_recall_of_near_lines_on_the_table(spark):
    """Over all lines of the table, against edit similarity alone (of pairs that share half their words)."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    label = _groups_of(spark, rows)
    norms = sorted(n for n in label if len(n) <= 2000)
    words, inside = [set(n.split()) for n in norms], defaultdict(list)
    frequency = Counter(w for s in words for w in s)
    pairs = set()
    for i, own in enumerate(words):
        rare = sorted(own, key=lambda w: (frequency[w], w))[: len(own) // 2 + 2]
        for j in {j for w in rare for j in inside[w]}:
            if 10 * abs(len(norms[i]) - len(norms[j])) <= max(len(norms[i]), len(norms[j])) and 2 * len(own & words[j]) >= max(len(own), len(words[j])):
                pairs.add((j, i))
        for w in rare:
            inside[w].append(i)
    told = spark.createDataFrame([(norms[i], norms[j]) for i, j in pairs], "a string, b string").filter("10 * levenshtein(a, b) <= greatest(length(a), length(b))").collect()
    found = sum(label[r.a] == label[r.b] for r in told)
    print("RECALL", found, len(told))
    assert len(told) > 200 and found >= 0.9 * len(told)


def test_short_and_unspaced_lines(spark):
    rows = [(1, "Yes.\nInternationalisierungsmassnahmen\n" + "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁"), (2, "Yes.\nINTERNATIONALISIERUNGSMASSNAHMEN!\n" + "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁。"), (3, "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁" + "永" * 2)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2].split("\n")[0] == "Yes." and "INTER" not in got[2]


def test_long_lines_are_compared_whole(spark):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a = text(2048)
    rows = [(a, a[:30] + text(n) + a[30:]) for n in (26, 40, 150, 227, 228)] + [(a[:30] + a[70:], a), (a, text(2048)), (a[:600], a[100:]), (a[:512], a[:8] + a[50:512])]
    rows += [(a, "".join(c if rng.random() > share else "z" for c in a)) for share in (0.05, 0.15)]
    got = [r.s for r in spark.createDataFrame(rows, "x string, y string").select(F.expr(lines.similar("x", "y")).alias("s")).collect()]
    assert got == [10 * _edit(x, y) <= max(len(x), len(y)) for x, y in rows] and got[:6] == [True, True, True, True, False, True]


def _edited(rng, line, edits):
    for _ in range(edits):
        at, c = rng.randrange(len(line)), rng.choice("klmnop")
        line = rng.choice((line[:at] + c + line[at + 1 :], line[:at] + c + line[at:], line[:at] + line[at + 1 :]))
    return line


@pytest.mark.parametrize("n", [5, 8, 12, 16, 20, 30, 50])
def test_lines_with_typos_are_found(spark, n):
    """Recall against the edit similarity alone, on pairs with one edit, 5 % and 10 % of edits."""
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 10)))
    rows, want = [], {}
    for i in range(60):
        line = " ".join(word() for _ in range(n))
        for j, edits in enumerate((1, max(1, len(line) // 20), len(line) // 10)):
            other = _edited(rng, line, edits)
            text = " ".join(other.split())
            rows.append((10 * i + j + 1, other))
            if len(text.split()) >= lines.LEAST_WORDS and 10 * _edit(line, text) <= max(len(line), len(text)):
                want[10 * i + j + 1] = j
        rows.append((10 * i, line))
    gone = {r.doc_id for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), typos=True).filter("n_removed > 0").collect()}
    found = [sum(k in gone for k, j in want.items() if j == kind) / max(1, sum(j == kind for j in want.values())) for kind in range(3)]
    print(n, found)
    assert found[0] == found[1] == 1 and found[2] >= 0.97 and gone <= {i for i, _ in rows if i % 10}


# ── all ──


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    assert_same(registry.queries()[name](spark, SMALL).toPandas(), duck(SMALL).execute(registry.oracle_sql()[name]).df())
