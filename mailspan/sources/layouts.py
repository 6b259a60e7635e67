"""Ways to write a table for the queries to come: clustered by a key for lookups, and bucketed for joins without shuffles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group and of a page of a lookup table: what a lookup reads at least.
GROUP_BYTES, PAGE_ROWS = 8 << 20, 1000


def write_lookup(df: DataFrame, path: str, key: str, files: int | None = None, others: tuple[str, ...] = (), group_bytes: int = GROUP_BYTES) -> None:
    """`df` in ranges of `key`, sorted: footers and page indexes then tell where a key can be. Keys in `others` have a bloom filter for each row
    group instead, as they lie anywhere."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = df.repartitionByRange(n, key).sortWithinPartitions(key).write.option("parquet.block.size", str(group_bytes)).option("parquet.page.row.count.limit", str(PAGE_ROWS))
    for c in others:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    w.parquet(path)


def lookup(spark: SparkSession, path: str, column: str, *keys: str) -> DataFrame:
    """The rows of some keys. The filter goes down to the scan, which leaves out files, row groups and pages."""
    return spark.read.parquet(path).filter(F.col(column).isin(*keys) if len(keys) > 1 else F.col(column) == keys[0])


def colocated(df: DataFrame, path: str, by: str, buckets: int) -> DataFrame:
    """`df` as a table in the session's catalogue, its files at `path`, bucketed and sorted by `by`: joins and aggregates by that column need no
    shuffle."""
    name = f"t_{uuid.uuid4().hex}"
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
