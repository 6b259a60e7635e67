"""What the operators of this subpackage share: tables, the shared folder, shipping code, and sizes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the text rules: runs of anything but ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place that all executors share; a folder of our own only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = os.path.join(tempfile.gettempdir(), "mailspan-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/mailspan-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` as a Parquet table in the shared folder: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a Spark context."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="mailspan-"), "mailspan_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for d, _, names in os.walk(root):
            for x in names:
                if x.endswith(".py"):
                    path = os.path.join(d, x)
                    z.write(path, os.path.join("mailspan", os.path.relpath(path, root)))
    sc.addPyFile(to)
    _SHIPPED.add(sc.applicationId)


def arrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds what one Arrow batch of texts may hold: rows, and bytes however long the texts are."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def utf8_bytes(column) -> "F.Column":
    """Length in UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
