"""Temperature mixing: token shares of the sources are raised to an exponent, the exponent is bisected to meet a
target entropy within a limit of repetitions, and the normalised weights become budgets of tokens, which block
permutations of each source fill epoch by epoch.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspan.llm._common import WORD, table, written

#: Share of the largest entropy that the mixture is to have, and how often a source may be seen at most.
TARGET, REPEATS, SEED = 0.9, 4, 17
STEPS = 60
BLOCK_ROWS = 50_000
#: The exponent's interval is cut into so many at a time, so often: 32^12 are 2^60 pieces.
CUTS, ROUNDS = 32, 12
#: Up to so many sources their plan is broadcast, more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def weights(tokens: dict, exponent: float) -> dict:
    total = sum(tokens.values())
    raw = {k: (t / total) ** exponent for k, t in tokens.items()}
    whole = sum(raw.values())
    return {k: x / whole for k, x in raw.items()}


def exponent(tokens: dict, target: float = TARGET, repeats: float = REPEATS) -> float:
    """The largest exponent up to 1 whose weights reach the entropy, but none under which a source would be repeated
    more than `repeats` times as often as the one repeated least. Rounded to six places."""

    def bisected(met) -> float:
        lo, hi = 0.0, 1.0
        if met(hi):
            return hi
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if met(mid) else (lo, mid)
        return lo

    goal = target * math.log(len(tokens)) if len(tokens) > 1 else 0.0
    flat = bisected(lambda e: -sum(w * math.log(w) for w in weights(tokens, e).values()) >= goal)
    most, least = max(tokens.values()), min(tokens.values())
    # repetitions are in proportion to share ** (e - 1); their ratio is (most / least) ** (1 - e)
    limit = 1 - math.log(repeats) / math.log(most / least) if most > least * repeats else 0.0
    return round(max(flat, limit), 6)


def plan(tokens: dict, target: float = TARGET, repeats: float = REPEATS, budget: int | None = None) -> dict:
    """source -> (weight, budget of tokens). Without `budget` the smallest that shows every source once at least."""
    full = {k: t for k, t in tokens.items() if t}
    if not full:
        return {k: (0.0, 0) for k in tokens}
    w = weights(full, exponent(full, target, repeats))
    total = budget if budget is not None else max(t / w[k] for k, t in full.items())
    share = {k: math.floor(x * total + 0.5) for k, x in w.items()}
    if budget is None:
        share = {k: max(full[k], b) for k, b in share.items()}
    return {k: (w.get(k, 0.0), share.get(k, 0)) for k in tokens}


def planned(sources: DataFrame, target: float = TARGET, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """`sources` (t tokens each) plus full, rest and epochs: the same plan as `plan`, for any number of sources. A job of Spark tells the
    entropy at many exponents at once; the driver gets these sums alone."""
    told = sources.filter("t > 0").agg(F.count("*").alias("k"), F.sum("t").alias("total"), F.max("t").alias("most"), F.min("t").alias("least")).first()
    whole = F.when(F.col("t") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    if not told.k:
        return sources.withColumns({"full": whole, "rest": F.lit(0).cast("long"), "epochs": F.lit(1).cast("long")})
    share = F.col("t").cast("double") / F.lit(float(told.total))
    goal = target * math.log(told.k) if told.k > 1 else 0.0

    def entropies(exponents: list[float]) -> list[float]:
        sums = [x for e in exponents for x in (F.sum(share ** F.lit(e)), F.sum(share ** F.lit(e) * F.lit(e) * F.log(share)))]
        got = sources.filter("t > 0").agg(*[x.alias(f"x{i}") for i, x in enumerate(sums)]).first()
        return [math.log(got[2 * i]) - got[2 * i + 1] / got[2 * i] for i in range(len(exponents))]

    lo, hi = 0.0, 1.0
    if entropies([1.0])[0] >= goal:
        lo = 1.0
    else:
        for _ in range(ROUNDS):
            inner = [lo + (hi - lo) * i / CUTS for i in range(1, CUTS)]
            met = [e for e, h in zip(inner, entropies(inner), strict=True) if h >= goal]
            lo, hi = max(met, default=lo), min((e for e in inner if e not in met), default=hi)
            if hi - lo < 1e-15:
                break
    limit = 1 - math.log(repeats) / math.log(told.most / told.least) if told.most > told.least * repeats else 0.0
    e = round(max(lo, limit), 6)
    norm = sources.filter("t > 0").agg(F.sum(share ** F.lit(e)).alias("s")).first().s
    weight = share ** F.lit(e) / F.lit(norm)
    total = float(budget) if budget is not None else sources.filter("t > 0").agg(F.max(F.col("t") / weight).alias("m")).first().m
    given = F.floor(weight * F.lit(total) + F.lit(0.5)).cast("long")
    given = given if budget is not None else F.greatest("t", given)
    out = sources.withColumn("given", F.when(F.col("t") > 0, given))
    out = out.withColumns({"full": F.when(F.col("t") == 0, F.lit(1)).otherwise(F.expr("try_divide(given - given % nullif(t, 0), t)")).cast("long"), "rest": F.coalesce(F.expr("given % nullif(t, 0)"), F.lit(0)).cast("long")})
    return out.withColumn("epochs", F.col("full") + (F.col("rest") > 0).cast("long")).drop("given")


def mixed(df: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", target: float = TARGET, repeats: float = REPEATS, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """Which rows are shown, and how often: source, epoch (from 0), doc_id, text_hash, tokens, token_start.

    Tokens are words. token_start is the number of tokens before a row in its source's permutation of that epoch; the
    last epoch ends before the row that would exceed the budget. Null sources are one source; texts without words have
    no tokens, and sources without tokens are shown once; equal rows follow each other; an empty table gives no rows. Any number of
    sources will do; other columns of `df` are ignored, whatever their names.
    """
    spark = df.sparkSession
    # regexp_count counts what split() would have to build
    rows = written(
        df.select(
            df[id_column].alias("doc_id"),
            df[source_column].cast("string").alias("source"),
            F.coalesce(F.regexp_count(df[text_column], F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
            F.coalesce(F.md5(df[text_column].cast("binary")), F.lit("")).alias("text_hash"),
        ),
        "tokens",
    )
    sources = written(rows.groupBy(F.col("source").alias("s")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n")), "sources")
    facts = sources.agg(F.count("*").alias("k"), F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()
    digits = 1
    while 16**digits * BLOCK_ROWS < facts.n:
        digits += 1
    sources = planned(sources, target, repeats, budget).select("s", "full", "rest", "epochs")
    sources = F.broadcast(sources) if facts.k <= BROADCAST_SOURCES else sources
    shown = rows.join(sources, rows["source"].eqNullSafe(sources["s"])).drop("s").filter("epochs > 0")
    shown = shown.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    shown = shown.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_hash"))))
    shown = shown.withColumn("block", F.substring("h", 1, digits))
    before = W.partitionBy("source", "epoch").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = shown.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("b")).withColumn("block_start", F.coalesce(F.sum("b").over(before), F.lit(0))).drop("b")
    inside = W.partitionBy("source", "epoch", "block").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    out = shown.withColumn("inner_start", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    b = blocks.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("block").alias("k"), "block_start")
    out = out.join(b, out["source"].eqNullSafe(b["s"]) & (out["epoch"] == b["e"]) & (out["block"] == b["k"]))
    out = out.withColumn("token_start", F.col("block_start") + F.col("inner_start"))
    out = out.filter((F.col("epoch") < F.col("full")) | (F.col("token_start") + F.col("tokens") <= F.col("rest")))
    return out.select("source", "epoch", "doc_id", "text_hash", "tokens", "token_start")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("text_hash")


_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens, coalesce(md5(text), '') AS th FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS t FROM d GROUP BY source),
p AS (SELECT source, t, t::DOUBLE / sum(t) OVER () AS share FROM s WHERE t > 0),
goal AS (SELECT {TARGET} * ln(count(*)) AS h, max(t)::DOUBLE / min(t) AS ratio FROM p),
bis(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT b.step, b.lo, b.hi,
          ln(sum(share ** ((b.lo + b.hi) / 2))) - sum(share ** ((b.lo + b.hi) / 2) * ((b.lo + b.hi) / 2) * ln(share)) / sum(share ** ((b.lo + b.hi) / 2)) >= any_value(goal.h) AS ok
        FROM bis b, p, goal WHERE b.step < {STEPS} GROUP BY b.step, b.lo, b.hi)),
e AS (
  SELECT round(greatest(CASE WHEN (SELECT -sum(share * ln(share)) FROM p) >= h THEN 1.0 ELSE (SELECT lo FROM bis WHERE step = {STEPS}) END,
                        CASE WHEN ratio > {REPEATS} THEN 1 - ln({REPEATS}) / ln(ratio) ELSE 0 END), 6) AS x FROM goal),
w AS (SELECT source, t, share ** x / sum(share ** x) OVER () AS w FROM p, e),
b AS (SELECT source, t, greatest(t, floor(w * max(t / w) OVER () + 0.5)::BIGINT) AS budget FROM w),
f AS (
  SELECT s.source, CASE WHEN s.t = 0 THEN 1 ELSE budget // b.t END AS full_epochs, CASE WHEN s.t = 0 THEN 0 ELSE budget % b.t END AS rest
  FROM s LEFT JOIN b ON s.source IS NOT DISTINCT FROM b.source),
x AS (
  SELECT f.source, f.full_epochs, f.rest, d.doc_id, d.tokens, epoch,
         md5('{SEED}|' || epoch || '|' || coalesce(doc_id::VARCHAR, '') || '|' || th) AS h
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source, LATERAL (SELECT unnest(range(0, full_epochs + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch)),
y AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS token_start FROM x)
SELECT source, epoch, doc_id, tokens, token_start FROM y WHERE epoch < full_epochs OR token_start + tokens <= rest
"""

QUERIES = {"op6_mixing": op6_mixing}
ORACLE_SQL = {"op6_mixing": _SQL}
