"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are
range-partitioned by them, overfull ranges are subdivided, and prefix sums place every record.

The order is that of (hash of the key column, tie column), so equal keys lie side by side and a hot key
spreads over as many ranges as its bytes need. Only narrow digests are shuffled, never the texts.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspan.llm._common import table, utf8_bytes, written

#: Samples for each range that is to be cut out: the error of a range's size is about 1 / sqrt of this.
SAMPLES_A_RANGE = 64
MIN_RANGES, MAX_RANGES = 32, 4096


def _sampled(records: DataFrame, every: int, seed: int) -> list[tuple[int, int]]:
    """Keys drawn with probability size / `every`, a large record several times: at most about total / every, on the driver."""
    u = F.pmod(F.xxhash64("k", "t", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.col("size") / F.lit(float(every)) + u).cast("int")
    rows = records.select("k", "t", copies.alias("c")).filter("c > 0").collect()
    return sorted(x for r in rows for x in [(r.k, r.t)] * r.c)


def _quantiles(sample: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def _range_of(cuts: list[tuple[int, int]]) -> "F.Column":
    """The number of cuts that are not above (k, t), by two looks at lists of about sqrt(n) cuts."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    cut = lambda x: f"named_struct('k', {x[0]}L, 't', {x[1]}L)" if x[0] > -(1 << 63) else f"named_struct('k', bigint('{x[0]}'), 't', {x[1]}L)"
    me = "named_struct('k', k, 't', t)"
    first = F.expr(f"size(filter(array({', '.join(cut(g[0]) for g in groups)}), x -> x <= {me}))")
    lists = "array(" + ", ".join("array(" + ", ".join(map(cut, g)) + ")" for g in groups) + ")"
    return F.when(first == 0, F.lit(0)).otherwise((first - 1) * F.lit(step) + F.size(F.filter(F.try_element_at(F.expr(lists), first), lambda x: x <= F.expr(me))))


def shard_by_bytes(df: DataFrame, id_column: str, text_column: str, shards: int = 8, range_bytes: int = 64 << 20, seed: int = 7) -> DataFrame:
    """One row for each of `df`'s rows: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot.

    Shards differ by about one record's size. Null texts count as empty; null ids sort first; equal rows get
    neighbouring slots; an empty table gives no rows; other columns of `df` are ignored, whatever their names.
    """
    spark = df.sparkSession
    text, ident = df[text_column], df[id_column]
    records = written(
        df.select(
            ident.alias("doc_id"),
            (utf8_bytes(text) + 1).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("k"),
            F.coalesce(ident.cast("long"), F.lit(-(1 << 63) + 1)).alias("t"),
        ),
        "records",
    )
    total = records.agg(F.sum("size")).first()[0] or 0
    parts = min(MAX_RANGES, max(MIN_RANGES, total // range_bytes))
    cuts = _quantiles(_sampled(records, max(1, total // (parts * SAMPLES_A_RANGE)), seed), parts)

    def measured() -> dict[int, tuple[int, int]]:
        """Bytes and rows by range: at most 2 * MAX_RANGES numbers."""
        got = records.groupBy(_range_of(cuts).alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        return {x.r: (x.b, x.n) for x in got}

    sizes = measured()
    target = max(1, total // parts)
    over = [r for r, (b, n) in sizes.items() if b > 1.5 * target and n > 1]
    if over:  # subdivide: denser samples in the overfull ranges alone
        inside = records.withColumn("r", _range_of(cuts)).filter(F.col("r").isin(over))
        finer = _sampled(inside, max(1, target // (4 * SAMPLES_A_RANGE)), seed + 1)
        more = []
        for r in over:
            own = finer[bisect_left(finer, cuts[r - 1]) if r else 0 : bisect_left(finer, cuts[r]) if r < len(cuts) else len(finer)]
            more += _quantiles(own, -(-sizes[r][0] // target))
        cuts = sorted({*cuts, *more})
        sizes = measured()

    before_b, before_n, b, n = [], [], 0, 0
    for r in range(len(cuts) + 1):
        before_b.append(b)
        before_n.append(n)
        b, n = b + sizes.get(r, (0, 0))[0], n + sizes.get(r, (0, 0))[1]
    at = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(before_b, before_n, strict=True))], "r int, before_b long, before_n long")
    ranged = records.withColumn("r", _range_of(cuts)).join(F.broadcast(at), "r")  # at most 2 * MAX_RANGES rows
    order = W.partitionBy("r").orderBy("k", "t", "size", "text_crc32")
    end = F.col("before_b") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))
    middle = end - F.col("size") / 2
    placed = (
        ranged.withColumn("row", F.col("before_n") + F.row_number().over(order) - 1)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(1, total))))).cast("int"))
    )
    # a shard starts in a range in which a multiple of total / shards falls, or (after a record that spans it) in the next that has rows
    edges = {r for r in range(len(cuts) + 1) if (before_b[r] * shards) // max(1, total) != ((before_b[r] + sizes.get(r, (0, 0))[0]) * shards) // max(1, total)}
    edges |= {next((x for x in range(r + 1, len(cuts) + 1) if x in sizes), r) for r in edges} | {min(sizes, default=0)}
    starts = {x.shard: x.s for x in placed.filter(F.col("r").isin(sorted(edges))).groupBy("shard").agg(F.min("row").alias("s")).collect()}
    start = F.coalesce(*[F.when(F.col("shard") == k, F.lit(v)) for k, v in starts.items()]) if starts else F.lit(0)
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - start).cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), "doc_id", "text", shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op1_sharding": op1_sharding}
