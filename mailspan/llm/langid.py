"""Language identification: multinomial naive Bayes over hashed character n-grams. Training counts are summed by
Spark, the matrix of log probabilities is broadcast, and whole texts are scored as sparse count vectors in numpy.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspan.llm._common import arrow_batches, free_name, table

#: Buckets of the hashed n-grams, their lengths, and the additive smoothing.
BUCKETS, ORDERS, ALPHA = 1 << 15, (1, 2, 3), 0.5
#: Training reads about this many labelled rows at most, chosen by a hash.
TRAINING_ROWS = 40_000
UNKNOWN = "und"
#: Products that are made at a time, and n-grams of a text from which on equal ones are counted first.
ENTRIES, LONG = 2_000_000, 2_000

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def buckets(text: str | None) -> np.ndarray | None:
    """Buckets of all n-grams of a whole text, with repeats; None if it has no letter. Case and what is between words don't count."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each run of letters
    codes = np.concatenate((np.array([32], np.uint32), codes[keep], np.array([32], np.uint32)))
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > len(codes):
            break
        h = (h[: len(codes) - n + 1] * np.uint32(0x01000193)) ^ (codes[n - 1 :] * np.uint32(0x9E3779B1))
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
            out.append(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(out)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one task: documents and n-grams by language and bucket (bucket -1: documents)."""
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = buckets(text)
            if found is not None:
                docs[lang] = docs.get(lang, 0) + 1
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(found, minlength=BUCKETS)
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        n = len(at) + 1
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(own[at], docs[lang]), pa.int64())], ["lang", "bucket", "n"])


def fit(df: DataFrame, text_column: str = "text", lang_column: str = "lang", training_rows: int = TRAINING_ROWS) -> dict:
    """languages, log_prob (buckets x languages, float32) and log_prior. What the driver gets is bounded by buckets times languages."""
    arrow_batches(df.sparkSession)
    labelled = df.select(df[text_column].cast("string").alias("text"), df[lang_column].cast("string").alias("lang")).filter("text is not null and lang is not null")
    share = min(1.0, training_rows / max(1, labelled.count()))
    # chosen row by row, not text by text: copies of one text must not fill the sample
    sample = labelled.filter(F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 20)) < int(share * (1 << 20) + 1))
    got = sample.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = (got.column(i).to_pylist() for i in range(3))
    languages = sorted(set(lang))
    index = {x: i for i, x in enumerate(languages)}
    counts, docs = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    for x, b, k in zip(lang, bucket, n, strict=True):
        if b < 0:
            docs[index[x]] = k
        else:
            counts[b, index[x]] = k
    log_prob = np.log((counts + ALPHA) / (counts.sum(0) + ALPHA * BUCKETS)) if languages else counts
    return {"languages": languages, "log_prob": log_prob.astype(np.float32), "log_prior": np.log(docs / docs.sum()) if languages else docs}


def predict(df: DataFrame, model: dict, text_column: str = "text") -> DataFrame:
    """`df` plus lang_pred and score (the posterior probability). Null texts, texts without a letter and all texts under
    an empty model are `und` with score 0; equal texts get equal predictions; whole texts count; columns of `df` with
    the new names are replaced."""
    spark = df.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    carried = [c for c in df.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        languages, log_prob, prior = m["languages"], m["log_prob"], m["log_prior"]
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            held, rows, size = [], [], 0

            def scored() -> None:
                """The rows held so far, as one sparse matrix of bucket counts (columns, values, row starts), times the matrix of log probabilities."""
                columns, values = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                starts = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
                joint = prior + np.add.reduceat(log_prob[columns] * values[:, None], starts, axis=0, dtype=np.float64)
                p = np.exp(joint - joint.max(1, keepdims=True))
                best = joint.argmax(1)
                for row, language, share in zip(rows, best.tolist(), (p[np.arange(len(best)), best] / p.sum(1)).tolist(), strict=True):
                    names[row], scores[row] = languages[language], share
                held.clear()
                rows.clear()

            for row, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                found = buckets(text) if languages else None
                if found is None:
                    continue
                values = np.ones(len(found), np.float32)
                if len(found) > LONG:  # no more entries than there are buckets
                    counts = np.bincount(found, minlength=BUCKETS)
                    found = np.flatnonzero(counts)
                    values = counts[found].astype(np.float64)
                held.append((found, values))
                rows.append(row)
                size += len(found) * len(languages)
                if size >= ENTRIES:
                    scored()
                    size = 0
            if held:
                scored()
            rest = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*carried, "lang_pred", "score"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried)
    return df.select(*carried, df[text_column].cast("string").alias(free_name(df, "_text"))).mapInArrow(run, f"{schema + ', ' if schema else ''}lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(docs.filter(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
