"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str = "table") -> str:
    """The path of a new folder below the one that the cluster names; a place of our own only where it names none, as on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{base.rstrip('/')}/mailspan-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` as a Parquet table in the shared folder: read as often as one likes, computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, column: str) -> DataFrame:
    """`df` dealt by `column` for a partitioned write: few files a folder. Large folders are split among tasks where Spark plans at run time; inside a
    stream's batch it does not, and would ignore the hint."""
    adaptive = df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    return df.hint("rebalance", column) if adaptive else df.repartition(column)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` over all cores, before work that costs far more time than its bytes suggest: partitions are otherwise cut by size, and few small rows would all go
    to one core. The number is explicit, as planning at run time would put them together again."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
