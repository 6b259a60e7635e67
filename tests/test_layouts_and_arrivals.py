"""Letters that arrive, live top ten, dead letters, progress, layouts that prune or need no shuffle, float vectors in splits."""

import os
import random
import re
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailspan.operators import pipeline, resolve
from mailspan.plans import catalogue
from mailspan.sources import ingest, layouts
from mailspan.sources.buckets import BucketTable
from mailspan.streaming import live
from mailspan.streaming.arrivals import Arrivals
from tests.helpers import SMALL

PARTY = "documentId string, role string, name string, organization string, email string, phone string, address string"
PROFILE = "id string, type string, name string, organization string, email string, phone string, createdAt long"


def _arrivals(spark, tmp_path, profiles):
    links = spark.createDataFrame([], "documentId string, profileId string, role string, createdAt long")
    stored = BucketTable(str(tmp_path / "p"), ("id",), "id", profiles.schema, 4).create(profiles)
    to = BucketTable(str(tmp_path / "l"), ("documentId", "profileId"), "documentId", links.schema, 4).create(links)
    return Arrivals.over(spark, str(tmp_path / "i"), stored, to, 1, buckets=8)


def _made(seed, n_profiles=60, n_parties=90):
    rng = random.Random(seed)
    names = ["Anna Berg", "Stadtwerke GmbH", "x_y AG", "Öffentliche Kasse", "Al", "50% Club", "Amt für Post"]
    profiles = [(f"p{i}", "PERSON", f"{rng.choice(names)} {rng.randrange(9)}" if rng.random() < 0.9 else rng.choice(names), rng.choice([None, rng.choice(names)]), None, None, i) for i in range(n_profiles)]
    parties = [(f"d{i // 2}", "SENDER" if i % 2 else "RECEIVER", rng.choice([None, rng.choice(names).upper(), f"{rng.choice(names)} 3", "A", "nobody at all"]), rng.choice([None, rng.choice(names)]), None, None, None) for i in range(n_parties)]
    return profiles, [p for p in parties if p[2] or p[3]]


@pytest.mark.parametrize("seed,cut", [(1, 1), (2, 3)])
def test_arrivals_link_what_a_batch_links(spark, tmp_path, seed, cut):
    profiles, parties = _made(seed)
    p, s = spark.createDataFrame(profiles, PROFILE), spark.createDataFrame(parties, PARTY)
    into = _arrivals(spark, tmp_path, p)
    want = {tuple(r) for r in resolve.matches(s, p).collect()}
    assert {tuple(r) for r in into.matches(s).collect()} == want and want
    for k in range(cut):
        into.take(s.filter(F.pmod(F.xxhash64("documentId"), F.lit(cut)) == k), k)
    links = {(r.documentId, r.profileId, r.role) for r in into.links.read(spark).collect()}
    assert links == {(r.documentId, r.profileId, r.role) for r in resolve.auto_links(resolve.suggestions(s, p), 1).collect()} and links


def test_profiles_that_are_learned(spark, tmp_path):
    profiles, _ = _made(3)
    into = _arrivals(spark, tmp_path, spark.createDataFrame(profiles, PROFILE))
    letter = lambda d, name: spark.createDataFrame([(d, "SENDER", name, None, None, None, None)], PARTY)
    into.take(letter("a", "Quentin Zorn"), 0)
    into.learn(spark.createDataFrame([("q", "PERSON", "Quentin Zorn", None, None, None, 99), ("p1", "PERSON", "Xaver Wyk", None, None, None, 1)], PROFILE))
    into.take(letter("b", "Quentin Zorn"), 1)
    into.take(letter("c", "Xaver Wyk"), 2)
    assert {(r.documentId, r.profileId) for r in into.links.read(spark).collect()} == {("b", "q"), ("c", "p1")}


def test_top_ten_after_each_batch(spark):
    kept, said = catalogue.live_top(spark, SMALL)
    state = {r.id: r.createdAt for r in kept.documents.read(spark).collect()}
    told = said.collect()
    for k in range(3):
        part = [r for r in told if int(r.id) % 3 == k]
        kept.apply(spark.createDataFrame(part, said.schema), k)
        for r in sorted(part, key=lambda r: r.seq):
            state.pop(r.id, None)
            if r.op == "put":
                state[r.id] = r.createdAt
        best = sorted(state.items(), key=lambda x: (-x[1], x[0]))[:10]
        assert [(r.id, r.createdAt) for r in kept.top(spark).collect()] == best and kept.total(spark).first()[0] == len(state)


def test_bad_rows_harm_no_other(spark):
    docs = [(f"d{i}", "Scan", "PROCESSING", None, "de", 0) for i in range(6)] + [("d1", "Scan", "PROCESSING", None, "de", 0), ("d6", "Scan", "?", "??", "de", 0)]
    d = spark.createDataFrame(docs, "id string, title string, status string, documentType string, language string, modifiedAt long")
    texts = [("d0", 1, b"Rechnung\nBetrag: 5,00 EUR"), ("d1", 1, b"x"), ("d2", 1, b"\xff\xfe"), ("d2", 2, b"good"), ("d3", 1, None), ("ghost", 1, b"x"), ("d6", 1, b"x"), ("d5", 1, b"")]
    pages = spark.createDataFrame(texts, "documentId string, pageNumber int, raw binary").select("documentId", "pageNumber", F.col("raw").cast("string").alias("ocrText"), F.lit(0.9).alias("ocrConfidence"))
    done = pipeline.process_contained(d, pages, 7)
    failed = {r.documentId: (r.error, r.detail) for r in done.failures.collect()}
    assert failed == {
        "d1": ("ExtractionFailed", "id: not unique"), "d2": ("ExtractionFailed", "ocrText: not UTF-8"), "ghost": ("ExtractionFailed", "documentId: no such document"),
        "d6": ("ExtractionFailed", "documentType: unknown value ??; status: unknown value ?"), "d4": ("OcrFailed", "No pages found for document"),
    }
    assert {r.id: r.status for r in done.documents.collect()} == {k: "EXTRACTED" for k in ("d0", "d3", "d5")}
    rows = {}
    for r in pipeline.progress(done, pages).orderBy("step").collect():
        rows.setdefault(r.documentId, []).append(r.progress)
    assert set(rows) == {"d0", "d3", "d5"} | set(failed)
    for doc, told in rows.items():
        assert told == sorted(told) and told[0] == 0 and (told[-1] == 1) == (doc not in failed)


def test_bad_rows_are_looked_for_once(spark):
    d = spark.createDataFrame([("a", "PROCESSING", None)], "id string, status string, documentType string")
    pages = spark.createDataFrame([("a", "x"), ("b", "y")], "documentId string, ocrText string")
    good, bad = pipeline.contained(d, pages)
    assert [r.id for r in good.collect()] == ["a"] and [r.documentId for r in bad.collect()] == ["b"]
    for part in (good, bad):
        assert "no such document" not in part._jdf.queryExecution().optimizedPlan().toString()


def test_progress_of_a_running_job(spark, tmp_path):
    for i in range(4):
        spark.range(10 * (i + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.range(1).schema
    refresh = live.with_progress(lambda b: b.filter("id % 2 = 0"), str(tmp_path / "out"), 50)
    assert live.progress_of(spark, str(tmp_path / "out")) is None
    live.observed(live.changes(spark, str(tmp_path / "in"), schema, 1), refresh, str(tmp_path / "ck")).awaitTermination()
    rows = live.progress_of(spark, str(tmp_path / "out")).orderBy("batch").collect()
    shares = [r.share for r in rows]
    assert len(rows) == 4 and shares == sorted(shares) and 0 < shares[0] and shares[-1] == 1.0
    assert sum(r.rows for r in rows) == spark.read.parquet(str(tmp_path / "out/rows")).count() == 50


def _scan(df):
    """The scan's metrics: files and rows that it gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    return {k: leaf.metrics().get(k).get().value() for k in ("numFiles", "numOutputRows")}


def test_lookups_read_little(spark, tmp_path):
    rows = spark.range(200_000).select(F.format_string("k%08d", "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("other"), F.lit("x" * 50).alias("text"))
    path = str(tmp_path / "t")
    layouts.write_lookup(rows, path, "id", files=4, others=("other",), group_bytes=1 << 20)
    one = layouts.lookup(spark, path, "id", "k00077777")
    assert one.count() == 1 and _scan(layouts.lookup(spark, path, "id", "k00077777"))["numOutputRows"] <= 2 * layouts.PAGE_ROWS
    assert layouts.lookup(spark, path, "id", "k00000001", "k00199999").count() == 2
    other = rows.filter("id = 'k00012345'").first().other
    assert layouts.lookup(spark, path, "other", other).count() == 1
    # a key that is not there: bloom filters leave out (nearly) all row groups, which lie between the least and the greatest key
    assert _scan(layouts.lookup(spark, path, "other", "7" * 64))["numOutputRows"] < 20_000


def test_colocated_tables_need_no_shuffle(spark):
    got = catalogue.colocated_detail(*catalogue.colocated_tables(spark, SMALL))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_float_rows_in_splits(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for name, n in (("a.bin", 1000), ("b.bin", 3), ("empty.bin", 0)):
        values = rng.standard_normal((n, 8)).astype("<f4")
        (tmp_path / name).write_bytes(values.tobytes() + b"\x01\x02" * (name == "b.bin"))
        want |= {(name, i): values[i].tolist() for i in range(n)}
    df = ingest.float_rows(spark, str(tmp_path), 8, split_rows=64)
    assert df.rdd.getNumPartitions() == 17
    assert {(os.path.basename(r.path), r.row): list(r["values"]) for r in df.collect()} == want


def test_a_file_over_2_gib_is_cut(tmp_path):
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(3 << 30)  # no bytes on disk
        f.seek((3 << 30) - 1024)
        f.write(np.full(256, 7, "<f4").tobytes())
    reader = ingest.FloatRowsReader(str(tmp_path), 256, ingest.SPLIT_ROWS)
    parts = reader.partitions()
    assert len(parts) == 48 and sum(p.value[2] for p in parts) == 3 << 20
    last = list(reader.read(ingest.InputPartition((*parts[-1].value[:1], (3 << 20) - 5, 5))))
    assert last[0].column(2).to_pylist()[-1] == [7.0] * 256 and last[0].column(1).to_pylist()[-1] == (3 << 20) - 1


def _like(text, needle):
    fold = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in fold(needle))
    return text is not None and re.search(pattern, fold(text), re.S) is not None


def test_needles_of_all_lengths_are_matched_by_blocks(spark):
    names = ["Amt", "a", "", "Stadt Köln 😀 am Rhein", "x" * 70 + "Y", "per 100%", "under_score", "Ministerium für Digitales und Verkehr", None]
    p = spark.createDataFrame([(str(i), n, names[-1 - i]) for i, n in enumerate(names)], "id string, name string, organization string")
    told = ["a", "AM", "amt", "Köln", "😀 am", "x" * 33, "x" * 71, "y", "%", "_", "", "%%a%", "r_c", "100%", "minister%verkehr", "für digitales und verk", "zz", "t", "Stadt KöLN 😀 am Rhein"]
    s = spark.createDataFrame([(str(i), "SENDER", None if i % 2 else n, n if i % 2 else None) for i, n in enumerate(told * 2 + ["Ä"])], "documentId string, role string, organization string, name string")
    rows = {(r.organization or r.name or "", r.organization is not None) for r in s.collect()}
    want = {(n, org, r.id) for n, org in rows for r in p.collect() if _like(r.name, n) or org and _like(r.organization, n)}
    assert {tuple(r) for r in resolve.matches(s, p, 0).collect()} == want


def test_blocks_of_numbered_names_are_small(spark):
    n = 3_000
    p = spark.range(n).selectExpr("cast(id as string) as id", "concat('Customer#', lpad(id, 9, '0')) as name", "cast(null as string) as organization")
    needles = p.selectExpr("name as needle", "false as org", "16 as size")
    # by trigrams each name would meet a share of all the others
    assert resolve.blocked(needles, p).count() <= 2 * n
    links = BucketTable(tempfile.mkdtemp() + "/links", ("documentId", "profileId"), "documentId", spark.createDataFrame([], "documentId string, profileId string, role string, createdAt long").schema, 2)
    into = Arrivals.over(spark, tempfile.mkdtemp(), BucketTable(tempfile.mkdtemp() + "/profiles", ("id",), "id", p.schema, 2).create(p), links, 1, 2)
    rarest = into.index.candidates(spark, into.index.asked(needles.select("needle")))
    assert rarest.count() <= 2 * n
    assert into.index.containing(spark, needles.select("needle")).count() == n


def test_processing_can_keep_what_it_extracted(spark):
    docs, pages = catalogue._pending(spark, SMALL)
    kept, anew = (pipeline.process(docs, pages, 1, keep=k) for k in (True, False))
    for part in ("fields", "documents", "events"):
        one, two = getattr(kept, part), getattr(anew, part)
        # regular expressions are the extraction's alone, so each letter is read once for all parts
        plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan(one)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
