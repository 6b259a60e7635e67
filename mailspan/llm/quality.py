"""Quality rules as a short-circuit cascade: each rule's cost and rejection rate are measured on a bounded
sample of rows, the rules are ordered by rejection per cost, and a row stops at the first rule that rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspan.llm._common import arrow_batches, free_name, table

#: Rows on which costs and rejection rates are measured (hash-chosen; a bound, whatever the input).
SAMPLE_ROWS = 2000
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)


class Measures:
    """The measures of one text, each computed when first asked for."""

    __slots__ = ("data", "_seen")

    def __init__(self, text: str | None):
        self.data = (text or "").encode("utf-8", "surrogatepass")
        self._seen: dict = {}

    def __getattr__(self, name: str):
        if name not in self._seen:
            self._seen[name] = MEASURES[name](self)
        return self._seen[name]


def _word_chars(m: Measures) -> int:
    joined = np.frombuffer(b"".join(m.words), np.uint8)
    return int(np.count_nonzero((joined & 0xC0) != 0x80))


def _lines(m: Measures) -> tuple[int, int]:
    """Lines with a word, and how many of these equal an earlier line."""
    full = [x for x in m.data.split(b"\n") if x.split(None, 1)]
    return len(full), len(full) - len(set(full))


def _repeat_words(m: Measures, span: int = 8) -> int:
    """Words in windows of `span` words that occur twice or more, by exact ranks of 2, 4 and 8 words."""
    n = len(m.words)
    if n <= span:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in m.words), np.int64, n)
    if len(ids) == n:
        return 0
    size, kinds = 1, len(ids)
    while size < span:
        pair = rank[:-size] * kinds + rank[size:]
        found, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        size, kinds = size * 2, len(found)
        if kinds == len(pair):
            return 0
    starts = np.flatnonzero(counts[rank] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + span, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


MEASURES: dict[str, Callable] = {
    "words": lambda m: m.data.split(),
    "n_words": lambda m: len(m.words),
    "word_chars": _word_chars,
    "n_symbols": lambda m: len(m.data.translate(None, _NOT_SYMBOL)),
    "lines": _lines,
    "n_lines": lambda m: m.lines[0],
    "n_dup_lines": lambda m: m.lines[1],
    "n_repeat_words": _repeat_words,
}

#: name -> whether a text is rejected. Every threshold is a whole-number comparison, so that SQL can say the same.
RULES: dict[str, Callable[[Measures], bool]] = {
    "few_words": lambda m: m.n_words < 20,
    "repeated_windows": lambda m: 100 * m.n_repeat_words > 30 * m.n_words,
    "symbols": lambda m: 10 * m.n_symbols > m.n_words,
    "word_length": lambda m: m.word_chars < 2 * m.n_words or m.word_chars > 12 * m.n_words,
    "repeated_lines": lambda m: 2 * m.n_dup_lines > m.n_lines,
}
BASE = ("few_words", "repeated_windows")


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each rule of a batch: rows, rejections, and seconds when the rule has to do all its work itself."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for name, rule in RULES.items():
            fresh = [Measures(t) for t in texts]
            began = time.perf_counter()
            rejected = sum(rule(m) for m in fresh)
            yield pa.RecordBatch.from_pydict({"rule": [name], "n": [len(texts)], "rejected": [rejected], "seconds": [time.perf_counter() - began]})


def rule_order(df: DataFrame, text_column: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> list[dict]:
    """The rules, best first: rejections per second over a sample of about `sample_rows` rows. A few numbers reach the driver."""
    arrow_batches(df.sparkSession)
    rows = df.count()
    share = min(1.0, sample_rows / max(1, rows))
    texts = df.select(df[text_column].cast("string").alias("text"))
    # chosen row by row, not text by text: copies of one text must not fill the sample
    sample = texts.filter(F.pmod(F.xxhash64("text", F.monotonically_increasing_id(), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20) + 1))
    got = sample.mapInArrow(_profile, "rule string, n long, rejected long, seconds double").groupBy("rule").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds")).collect()
    seen = {r.rule: r for r in got}
    out = []
    for name in RULES:
        r = seen.get(name)
        rate, cost = ((r.rejected + 0.5) / (r.n + 1), r.seconds / max(1, r.n)) if r else (0.5, 1e-6)
        out.append({"rule": name, "rejects": rate, "cost": cost, "gain": rate / max(cost, 1e-9)})
    return sorted(out, key=lambda x: -x["gain"])


def cascade(df: DataFrame, text_column: str = "text", order: list[str] | None = None, measures: bool = False) -> DataFrame:
    """`df` plus kept (boolean) and rejected_by (the first rule that rejects, in cascade order; null if kept).

    measures: also n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed, for every
    row. Null and empty texts have no words and are rejected; long texts are measured whole; equal rows get equal
    verdicts; an empty table gives no rows. Columns of `df` that have a new column's name are replaced.
    """
    arrow_batches(df.sparkSession)
    order = order or [x["rule"] for x in rule_order(df, text_column)]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"] if measures else []
    new = [*counts, *(["base_failed"] if measures else []), "kept", "rejected_by"]
    carried = [c for c in df.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in new}
            for text in batch.column(batch.num_columns - 1).to_pylist():
                m = Measures(text)
                by = next((name for name in order if RULES[name](m)), None)
                columns["kept"].append(by is None)
                columns["rejected_by"].append(by)
                for c in counts:
                    columns[c].append(getattr(m, c))
                if measures:
                    columns["base_failed"].append(any(RULES[name](m) for name in BASE))
            arrays = list(batch.columns[:-1])
            arrays += [pa.array(columns[c], pa.int64() if c in counts else pa.string() if c == "rejected_by" else pa.bool_()) for c in new]
            yield pa.RecordBatch.from_arrays(arrays, [*carried, *new])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried] + [f"{c} {'long' if c in counts else 'string' if c == 'rejected_by' else 'boolean'}" for c in new])
    return df.select(*carried, df[text_column].alias(free_name(df, "_text"))).mapInArrow(run, schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = cascade(docs.select("doc_id", "text"), measures=True)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (
  SELECT rid, i, list_aggregate(w[i:i+7], 'string_agg', ' ') AS g
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i) WHERE len(w) >= 8),
rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT rid, count(DISTINCT i + o) AS n_repeat_words
  FROM rep, (SELECT unnest(range(0, 8)) AS o) GROUP BY rid),
s AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_words,
         coalesce(length(list_aggregate(d.w, 'string_agg', '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(l.n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN lines l USING (rid) LEFT JOIN cov c USING (rid)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
            OR word_chars > 12 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""

QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLE_SQL = {"op4_quality_rules": _SQL}
