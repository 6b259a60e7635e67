"""Ways into the store: scanned page lists, recognised text with confidences, preferences, and float vectors in files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_PAGES = 10  # of a scan
#: Float vectors: values a row, rows of a split (64 MiB of 256 values) and of one read.
WIDTH, SPLIT_ROWS, BATCH_ROWS = 256, 1 << 16, 4096
PREFERENCES = {"theme": "SYSTEM", "auto_process": "true", "language": "de", "notifications": "true", "biometric": "false"}


def scanned_pages(scans: DataFrame, id_column: str = "id", uris_column: str = "uris") -> DataFrame:
    """documentId, pageNumber (from 1), imagePath, pageCount of scans; no more than ten pages each."""
    uris = F.slice(F.col(uris_column), 1, MOST_PAGES)
    return scans.select(F.col(id_column).alias("documentId"), F.size(uris).alias("pageCount"), F.posexplode(uris).alias("p", "imagePath")).select("documentId", (F.col("p") + 1).alias("pageNumber"), "imagePath", "pageCount")


def mean_confidence(confidences: Column) -> Column:
    """Mean of the lines' confidences without nulls: 0 for no lines, NaN for none but nulls."""
    told = F.filter(confidences, lambda x: x.isNotNull())
    total = F.aggregate(told, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(confidences) == 0, F.lit(0.0)).when(F.size(told) == 0, F.lit(float("nan"))).otherwise(total / F.size(told)).cast("float")


def recognised(blocks: DataFrame) -> DataFrame:
    """A page a row from (document_id, page_number, block, text, confidences): its text, its blocks' means, and its own mean."""
    w = blocks.withColumn("block_mean", mean_confidence(F.col("confidences")))
    page = w.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("block", "text", "block_mean", "confidences"))).alias("b"))
    return page.select(
        "document_id", "page_number", F.array_join(F.col("b.text"), "\n").alias("ocr_text"), F.col("b.block_mean").alias("block_confidences"), mean_confidence(F.flatten("b.confidences")).alias("confidence")
    )


def preferences(stored: DataFrame) -> DataFrame:
    """One row of settings from (key, value), with defaults; an unknown theme is SYSTEM, an unreadable switch its default."""
    known = {k: F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in PREFERENCES}
    row = stored.agg(*known.values(), F.max(F.when(F.col("key") == "active_model", F.col("value"))).alias("active_model"))
    switch = lambda k: F.coalesce(F.expr(f"try_cast({k} as boolean)"), F.lit(PREFERENCES[k] == "true")).alias(k)
    theme = F.when(F.col("theme").isin("LIGHT", "DARK", "SYSTEM"), F.col("theme")).otherwise("SYSTEM").alias("theme")
    return row.select(theme, switch("auto_process"), F.coalesce("language", F.lit(PREFERENCES["language"])).alias("language"), switch("notifications"), switch("biometric"), "active_model")


def set_preference(stored: DataFrame, key: str, value: str | None) -> DataFrame:
    """`stored` with one value set; none removes the key."""
    rest = stored.filter(F.col("key") != key)
    return rest if value is None else rest.unionByName(stored.sparkSession.createDataFrame([(key, value)], "key string, value string"))


class FloatRows(DataSource):
    """Rows of little-endian float32 values in binary files, read in splits: path, row (from 0), values. Options: path (a file or folder, any that
    pyarrow can open), width (values a row), split_rows."""

    @classmethod
    def name(cls) -> str:
        return "float_rows"

    def schema(self) -> str:
        return "path string, row long, values array<float>"

    def reader(self, schema) -> FloatRowsReader:
        return FloatRowsReader(self.options["path"], int(self.options.get("width", WIDTH)), int(self.options.get("split_rows", SPLIT_ROWS)))


class FloatRowsReader(DataSourceReader):
    def __init__(self, path: str, width: int, split_rows: int):
        self.path, self.width, self.split_rows = path, width, split_rows

    def partitions(self) -> list[InputPartition]:
        """(file, first row, rows): whole rows only, what is left at a file's end is none. Only sizes are looked at."""
        fs, at = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path.removeprefix("file:"))
        info = fs.get_file_info(at)
        files = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.is_file]
        return [InputPartition((f.path, first, min(self.split_rows, n - first))) for f in sorted(files, key=lambda f: f.path) for n in [f.size // (4 * self.width)] for first in range(0, n, self.split_rows)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, first, rows = partition.value
        fs = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
        with fs.open_input_file(path) as f:
            for start in range(first, first + rows, BATCH_ROWS):
                n = min(BATCH_ROWS, first + rows - start)
                f.seek(4 * self.width * start)
                values = np.frombuffer(f.read(4 * self.width * n), "<f4").astype(np.float32, copy=False)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, self.width, dtype=np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(start, start + n)), lists], ["path", "row", "values"])


def float_rows(spark: SparkSession, path: str, width: int = WIDTH, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Rows of `width` little-endian float32 values from binary files: path, row, values. A file of any size is read in splits."""
    spark.dataSource.register(FloatRows)
    return spark.read.format("float_rows").option("width", width).option("split_rows", split_rows).load(path)
