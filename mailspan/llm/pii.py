"""Personal data by weak supervision: regex, gazetteer, context and checksum labelers vote on candidate spans,
expectation-maximisation over the counts of all vote patterns estimates how reliable each is, and the resulting soft
labels train the classifier that decides about spans beyond the exact base kinds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspan.llm._common import arrow_batches, free_name, table

#: Kinds that are found exactly, and kinds that the classifier decides about, in the order of all outputs.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("email_words", "phone_local", "secret")
THRESHOLD, ROUNDS = 0.8, 30
CONTEXT = 32

#: Gazetteers and cue words of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov int info biz io co de at ch fr es it nl be uk eu us ca au example test".split())
SECRET_NAMES = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "bearer")
SECRET_PREFIXES = ("AKIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "eyJ")
CUES = {
    "email": ("mail", "contact", "kontakt", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "karte", "visa", "tarjeta", "carte", "payment"),
    "phone": ("tel", "phone", "fon", "call", "mobil", "fax"),
    "email_words": ("mail", "contact", "kontakt", "write", "correo", "courriel"),
    "phone_local": ("tel", "phone", "fon", "call", "mobil", "fax"),
    "secret": ("=", ":"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# no address starts inside a run of digits: what precedes a run's end decides nothing about what follows it
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORDS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}+(?: ?[\[(]dot[\])] ?| dot )[A-Za-z]{2,24}(?![A-Za-z])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the exact kinds, by kind and start. Null is empty."""
    text = text or ""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for kind, pattern, least, most in (("card", _CARD, 13, 19), ("phone", _PHONE, 9, 15)):
            for m in pattern.finditer(text):
                if m.end() - m.start() < least:
                    continue
                digits = "".join(filter(str.isdigit, m[0]))
                if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                    out.append((kind, m.start(), m.end()))
    return out


def extra_candidates(text: str | None, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the other kinds that meet no base span."""
    text, out = text or "", []
    if "dot" in text:
        out += [("email_words", m.start(), m.end()) for m in _WORDS.finditer(text)]
    if _DIGIT.search(text):
        out += [("phone_local", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
        out += [("secret", m.start(), m.end()) for m in _SECRET.finditer(text) if len(_DIGIT.findall(m[0])) >= 4]
    if not out or not base:
        return out
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    ends = np.maximum.accumulate([b for _, b in taken])

    def free(a: int, b: int) -> bool:
        i = int(np.searchsorted(starts, b, "left"))
        return i == 0 or ends[i - 1] <= a

    return [x for x in out if free(x[1], x[2])]


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, int, int, int, int]:
    """What the regex, gazetteer, context and checksum labelers say (1, -1, or 0 to abstain), and the length's class."""
    span, before = text[start:end], text[max(0, start - CONTEXT) : start].lower()
    cue = any(c in before for c in CUES[kind])
    if kind in ("email", "email_words"):
        last = re.split(r"[.\s\[\]()]+", span)[-1].lower()
        shape, listed, check = 1, 1 if last in TOP_DOMAINS else -1, 1 if len(span) <= 254 else -1
    elif kind == "ip":
        parts = span.split(".")
        shape, listed, check = 1, 0 if parts[0] not in ("10", "127", "192") else 1, -1 if any(len(p) > 1 and p[0] == "0" for p in parts) else 1
    elif kind == "card":
        shape, listed, check = 1, 1 if span[0] in "3456" else -1, 1
    elif kind in ("phone", "phone_local"):
        shape, listed, check = 1, 1 if kind == "phone" else 0, 1 if len(set(filter(str.isdigit, span))) > 2 else -1
    else:
        name = before.rstrip(" \"'").rstrip("=:").rstrip()
        shape = 1 if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span) or re.search(r"[a-z]", span) and re.search(r"[A-Z]", span) else -1
        listed = 1 if span.startswith(SECRET_PREFIXES) or name.endswith(SECRET_NAMES) else -1
        cue = before.rstrip(" \"'").endswith(("=", ":"))
        check = 1 if _entropy(span) >= 3 and re.search("[A-Za-z]", span) else -1
    return shape, listed, 1 if cue else (-1 if kind == "secret" else 0), check, min(3, len(span) // 16)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            base = base_spans(text)
            for span in base + extra_candidates(text, base):
                seen[(span[0], *votes(text, *span))] += 1
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), *(pa.array([k[i] for k in seen], pa.int32()) for i in range(1, 6)), pa.array(list(seen.values()), pa.int64())], ["kind", "shape", "listed", "cue", "checked", "length", "n"])


def _reliabilities(v: np.ndarray, n: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and for each labeler P(vote | class), by expectation-maximisation; a prior for each kind."""
    p = 1 / (1 + np.exp(-v.sum(1)))
    like = np.empty((2, v.shape[1], 3))
    for _ in range(ROUNDS):
        for c, w in ((0, n * (1 - p)), (1, n * p)):
            for j in range(v.shape[1]):
                like[c, j] = [w[v[:, j] == x].sum() + 1 for x in (-1, 0, 1)]
                like[c, j] /= like[c, j].sum()
        prior = np.empty(len(v))
        for k in set(kinds):
            at = kinds == k
            prior[at] = ((n * p)[at].sum() + 1) / (n[at].sum() + 2)
        logs = [sum(np.log(like[c, j, v[:, j] + 1]) for j in range(v.shape[1])) for c in (0, 1)]
        p = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - prior) - logs[1] - np.log(prior), -30, 30)))
    return p, like


def _features(kind: str, v: tuple) -> np.ndarray:
    x = np.zeros(1 + len(BASE + EXTRA) + 4 * 3 + 4)
    x[0] = 1
    x[1 + (BASE + EXTRA).index(kind)] = 1
    for j in range(4):
        x[1 + len(BASE + EXTRA) + 3 * j + v[j] + 1] = 1
    x[-4 + v[4]] = 1
    return x


def train(df: DataFrame, text_column: str = "text") -> dict:
    """reliability (P(vote | class) by labeler) and weights of the span classifier. All rows count; the driver gets one
    row for each vote pattern, of which there are at most 7 * 81 * 4."""
    arrow_batches(df.sparkSession)
    found = df.select(df[text_column].cast("string").alias("text")).mapInArrow(_patterns, "kind string, shape int, listed int, cue int, checked int, length int, n long")
    rows = found.groupBy("kind", "shape", "listed", "cue", "checked", "length").agg(F.sum("n").alias("n")).orderBy("kind", "shape", "listed", "cue", "checked", "length").collect()
    if not rows:
        return {"reliability": None, "weights": None}
    v = np.array([[r.shape, r.listed, r.cue, r.checked] for r in rows])
    n, kinds = np.array([r.n for r in rows], float), np.array([r.kind for r in rows])
    soft, like = _reliabilities(v, n, kinds)
    x = np.stack([_features(r.kind, (r.shape, r.listed, r.cue, r.checked, r.length)) for r in rows])
    w, share = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(50):  # weighted logistic regression, Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - soft)) + 1e-4 * w
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return {"reliability": like, "weights": w}


def find(df: DataFrame, model: dict, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`df` plus pii: array of (kind, start, end), code points, end exclusive, by kind as listed and then start.

    Base spans are always there; others where the classifier's probability reaches `threshold`. Null and empty texts
    have none; whole texts are searched in time linear in their length; equal texts get equal spans; a column of `df`
    named pii is replaced.
    """
    arrow_batches(df.sparkSession)
    carried = [c for c in df.columns if c != "pii"]
    weights = model["weights"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, bool] = {}

        def accepted(text: str, span: tuple) -> bool:
            key = (span[0], *votes(text, *span))
            if key not in known:
                known[key] = weights is not None and 1 / (1 + math.exp(-max(-30, min(30, _features(key[0], key[1:]) @ weights)))) >= threshold
            return known[key]

        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                base = base_spans(text)
                more = sorted((s for s in extra_candidates(text, base) if accepted(text, s)), key=lambda s: (EXTRA.index(s[0]), s[1]))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in base + more])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], [*carried, "pii"])

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in carried) + "pii array<struct<kind: string, start: bigint, end: bigint>>"
    return df.select(*carried, df[text_column].cast("string").alias(free_name(df, "_text"))).mapInArrow(run, schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest_sha(spans: list[tuple[str, int, int]]) -> str:
    return sha256(digest(spans).encode()).hexdigest()


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs)).withColumn("base", F.filter("pii", lambda s: s["kind"].isin(*BASE)))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("pii").alias("spans"))


QUERIES = {"op5_pii": op5_pii}
