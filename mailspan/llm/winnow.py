"""Document fingerprints by winnowing: rolling hashes of all k-grams of code points, in each window of w hashes the
smallest one (of equal ones the rightmost), and its position.

Two texts that share a passage of at least ``k + w - 1`` code points share a hash: every window that lies inside the passage
is in both, and so is the hash that it chooses. Texts of fewer than k code points are one gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from mailspan.llm._common import arrow_batches, table

#: Code points of a gram, and hashes of a window: passages of 46 code points are found.
GRAM, WINDOW = 16, 31
#: Documents that one stretch of the order is meant to hold, the most stretches, and ids drawn for each to cut them.
STRETCH_ROWS, MOST_STRETCHES, DRAWN = 8192, 1 << 16, 32
#: The hash's base (odd), its inverse modulo 2^64, and the mixing constants.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

Fingerprint = tuple[np.ndarray, np.ndarray]  # hashes (uint64) and positions, by position


class _Powers:
    """Powers of the base and of its inverse, as many as the longest text so far needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            factors = np.ones((2, 1 << (n - 1).bit_length()), np.uint64)
            factors[:, 1:] = np.array([[BASE], [INVERSE]], np.uint64)
            self.up, self.down = np.multiply.accumulate(factors, axis=1)
        return self.up, self.down


_POWERS = _Powers()


def gram_hashes(codes: np.ndarray, k: int = GRAM) -> np.ndarray:
    """The hash of each k-gram of `codes`: differences of one prefix sum, so that every code point is worked on once."""
    n = len(codes)
    k = min(k, n)
    if not n:
        return np.empty(0, np.uint64)
    up, down = _POWERS.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * up[k - 1 : n]
    h ^= h >> np.uint64(30)
    h *= np.uint64(MIX[0])
    h ^= h >> np.uint64(27)
    h *= np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


def winnow(hashes: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Positions that some window of `w` hashes chooses, ascending; fewer hashes than that are one window."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    w = min(w, n)
    at, width = np.arange(n), 1
    while width < w:  # the choices of windows of `width` give those of up to twice as many hashes
        step = min(width, w - width)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(hashes[right] <= hashes[left], right, left)
        width += step
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def fingerprint(text: str | None, k: int = GRAM, w: int = WINDOW) -> Fingerprint:
    h = gram_hashes(np.frombuffer((text or "").encode("utf-32-le"), "<u4"), k)
    at = winnow(h, w)
    return h[at], at


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Shared hashes of all hashes of both; two empty fingerprints are alike."""
    x, y = np.unique(a[0]), np.unique(b[0])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def rendered(f: Fingerprint) -> str:
    return ",".join([f"{h:016x}:{p}" for h, p in zip(f[0].tolist(), f[1].tolist(), strict=True)])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, hashes (unsigned 64 bits, as signed longs), positions: one row for each of `df`'s rows, without a
    shuffle. Null and empty texts have no hashes, whole texts are read whatever their length, equal rows are equal rows, no rows
    give none, and other columns of `df` are ignored, whatever their names."""
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [fingerprint(t, k, w) for t in texts]
            columns = [b.column(0), pa.array([len(t or "") for t in texts], pa.int64())]
            columns += [pa.array([x[0].view(np.int64) for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "hashes", "positions"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column].alias("doc_id"), df[text_column].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_chars long, hashes array<long>, positions array<long>")


def _stretches(ids: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids that cut the order into stretches, the greatest id of each stretch that has rows, and the stretch just above it in the order.

    On the driver: at most MOST_STRETCHES * DRAWN ids once, and two numbers for each stretch."""
    n = ids.count()
    parts = max(1, min(MOST_STRETCHES, -(-n // rows)))
    share = min(1.0, parts * DRAWN / max(1, n))
    drawn = ids.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) <= int(share * (1 << 30))).filter("doc_id is not null").toPandas()
    sample = np.sort(drawn["doc_id"].to_numpy(np.int64))
    cuts = np.unique(sample[[len(sample) * i // parts for i in range(1, parts)]]) if len(sample) else sample
    own = _own_stretch(cuts)
    heads = ids.select("doc_id", own("doc_id").alias("s")).groupBy("s").agg(F.max("doc_id").alias("head")).toPandas().sort_values("s")
    s = heads["s"].to_numpy(np.int64)
    head = np.array([-(1 << 63) if pd.isna(x) else int(x) for x in heads["head"].tolist()], np.int64)
    return cuts, head, np.roll(s, -1)  # the greatest id of all follows the last document


def _own_stretch(cuts: np.ndarray):
    @F.pandas_udf(LongType())
    def own(ids: pd.Series) -> pd.Series:
        none = ids.isna()
        return pd.Series(np.where(none, -1, np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), side="right")))

    return own


def edited_with_next(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = GRAM, w: int = WINDOW, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """Each document against its edited text, whose second half is the beginning of the next document, and against that next one.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (`hash:position`, comma-joined), near_edited, near_next.
    The order is descending by id, equal ids by text, null ids last; the first document follows the last. Null texts are
    empty; two empty texts are alike. Each of equal rows is a document, a table of one row follows itself, no rows give none, and other
    columns of `df` are ignored, whatever their names. Ids are whole numbers.

    The order is cut into stretches at sampled ids. Texts are shuffled once, to their stretch; only the head of a stretch is
    sent to the one before it too. A task reads its stretches one after another and holds two texts at a time.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    docs = df.select(df[id_column].cast("long").alias("doc_id"), df[text_column].cast("string").alias("text"))
    cuts, head, above = _stretches(docs.select("doc_id"), stretch_rows)
    order = np.argsort(head, kind="stable")
    head, above = head[order], above[order]
    places = ArrayType(StructType([StructField("s", LongType()), StructField("guest", BooleanType())]))

    @F.pandas_udf(places)
    def to(ids: pd.Series) -> pd.Series:
        none = ids.isna()
        x = ids.fillna(0).to_numpy(np.int64)
        own = np.where(none, -1, np.searchsorted(cuts, x, side="right"))
        x = np.where(none, -(1 << 63), x)
        i = np.minimum(np.searchsorted(head, x), len(head) - 1)
        return pd.Series([[{"s": o, "guest": False}] + ([{"s": a, "guest": True}] if first else []) for o, a, first in zip(own.tolist(), above[i].tolist(), (head[i] == x).tolist(), strict=True)])

    placed = docs.select(F.explode(to("doc_id")).alias("p"), "doc_id", "text").select("p.s", "p.guest", "doc_id", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = placed.repartition(parts, "s").sortWithinPartitions("s", "guest", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last = None  # (id, text, fingerprint) of the document that waits for its next one
        for b in batches:
            out = []
            for guest, doc, text in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if guest and last is None:  # of heads with equal ids the first one counts
                    continue
                text = text or ""
                found = fingerprint(text, k, w) if last is None or text != last[1] else last[2]
                if last is not None:
                    own, half = last[1], len(last[1]) // 2
                    edited = own[: len(own) - half] + text[:half]
                    f = last[2] if edited == own else fingerprint(edited, k, w)
                    out.append((last[0], len(own), hashlib.sha256(edited.encode()).hexdigest(), rendered(last[2]), rendered(f), likeness(last[2], f), likeness(last[2], found)))
                last = None if guest else (doc, text, found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op12_fingerprints": op12_fingerprints}
