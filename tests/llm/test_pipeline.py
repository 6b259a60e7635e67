"""The pipeline's stages, each on what its predecessor wrote, against plain versions where these exist."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from mailspan.llm import quality
from tests.helpers import SMALL
from tests.llm.test_operators import _groups_of, _plain_components, _plain_lines, _plain_measures


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, f in p.STAGES:
        docs = f(spark, docs, SMALL)
        out.append(docs.persist())
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert len(p.STAGES) == 5 and all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality(stages):
    def keeps(text):
        n, chars, symbols, dup, repeat = _plain_measures(text)
        full = sum(1 for x in (text or "").split("\n") if x.split())
        return n >= 20 and 100 * repeat <= 30 * n and 10 * symbols <= n and 2 * n <= chars <= 12 * n and 2 * dup <= full

    assert set(rows(stages[1])) == {i for i, r in rows(stages[0]).items() if keeps(r.text)} and quality.BASE


def test_lines(spark, stages):
    """One line of each of the operator's groups stays; its groups are tested against edit similarity in test_operators."""
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = _plain_lines(before, _groups_of(spark, before))
    assert {i: r.text for i, r in rows(stages[2]).items()} == {i: t for i, t in want.items() if t.split()}
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_one_of_each_group_stays(stages):
    want = {i for i, _, c in _plain_components([(r.doc_id, r.text) for r in stages[2].collect()]) if i == c}
    assert set(rows(stages[3])) == want and stages[3].count() == len(want)


def test_mixture_shows_all(stages):
    assert set(rows(stages[4])) == set(rows(stages[3]))
    assert max(Counter(r.doc_id for r in stages[4].collect()).values()) <= 5


def test_pieces_are_packed(stages):
    got = stages[5]
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").isEmpty()
    assert got.filter("piece = 0").count() == stages[4].count()


def test_empty(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, f in p.STAGES:
        docs = f(spark, docs, SMALL)
        assert docs.isEmpty()


def test_odd_rows(spark):
    """Columns named like those of operators keep their contents; ids that are repeated or missing lose no text of their own."""
    words = lambda k, n=40: " ".join(f"word{k}x{i}" for i in range(n))
    rows = [(1, words(1)), (1, words(2)), (2, words(1)), (None, words(3)), (None, words(3)), (None, words(3) + " more"), (5, words(4)), (5, words(4)), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars", "'mine' as kept", "'mine' as rejected_by", "'mine' as n_removed", "'mine' as `group`", "'mine' as _d", "'mine' as _h", "'mine' as _s", "'mine' as _text", "'mine' as e")
    good = p.quality_rules(spark, docs, SMALL)
    assert good.columns == docs.columns and good.filter("kept = 'mine' and rejected_by = 'mine'").count() == 8
    assert p.line_dedup(spark, good, SMALL).filter("n_removed <> 'mine'").isEmpty()
    left = p.jaccard_join(spark, docs, SMALL)
    assert left.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in left.collect())
    assert got[1, words(1)] == 1 and got[1, words(2)] == 1 and got[2, words(1)] == 0 and got[5, words(4)] == 1 and sum(got.values()) == 6
    assert sum(n for (i, t), n in got.items() if i is None) == 1
    shown = p.source_mixture(spark, docs, SMALL)
    assert shown.columns == docs.columns and shown.filter("_h <> 'mine' or e <> 'mine'").isEmpty()
    assert Counter((r.doc_id, r.text) for r in shown.collect()) == Counter(r[:2] for r in rows)
    pieces = p.best_fit_packing(spark, docs, SMALL)
    assert pieces.filter("piece = 0").count() == len(rows)
    none = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, SMALL).isEmpty()
