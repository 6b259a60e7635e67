"""The detail of each document as a table that follows its sources: a batch of changes works on the documents it names alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from mailspan.operators import reads, store
from mailspan.sources.buckets import BucketTable, delete_cascading
from mailspan.sources.folders import written
from mailspan.streaming.live import changes, observed

#: A change: its place in the order, table, `put` (insert or update) or `drop`, the document it belongs to, and the row as JSON (of a drop, its keys).
CHANGE = "seq long, name string, op string, documentId string, row string"


def change(name: str, op: str, document: str, seq, row: list[str]) -> list:
    """Columns of a change to table `name`, from a frame's own columns."""
    return [seq.cast("long").alias("seq"), F.lit(name).alias("name"), F.lit(op).alias("op"), F.col(document).alias("documentId"), F.to_json(F.struct(*row)).alias("row")]


@dataclass(frozen=True)
class LiveDetail:
    """documents, pages, fields and events in buckets by document, and below `path` the view: id, pages, fields, events, version (the
    batch that wrote the row)."""

    path: str
    documents: BucketTable
    pages: BucketTable
    fields: BucketTable
    events: BucketTable

    def tables(self) -> dict[str, BucketTable]:
        return {"documents": self.documents, "document_pages": self.pages, "extracted_data": self.fields, "timeline_events": self.events}

    def _of(self, spark: SparkSession, ids: DataFrame | None) -> DataFrame:
        """The detail of these documents (of all without `ids`), from their buckets."""

        def part(t: BucketTable, of: DataFrame | None) -> DataFrame:
            if of is None:
                return t.read(spark)
            named = of.withColumnRenamed("id", t.by)
            return t.read(spark, t.touched(named)).join(named, t.by, "left_semi")

        # what hangs on no document is never gathered
        shown = written(part(self.documents, ids).select("id"), "shown")
        return reads.detail(shown, part(self.pages, shown), part(self.fields, shown), part(self.events, shown))

    def view(self, spark: SparkSession) -> BucketTable:
        none = lambda t: spark.createDataFrame([], t.schema)  # noqa: E731  the schema needs no table
        made = reads.detail(none(self.documents).select("id"), none(self.pages), none(self.fields), none(self.events)).schema
        schema = spark.createDataFrame([], made.simpleString()).schema  # as a stored table has it: everything may be null
        return BucketTable(self.path, ("id",), "id", StructType(list(schema)).add("version", LongType()), self.documents.buckets)

    def build(self, spark: SparkSession) -> LiveDetail:
        self.view(spark).create(self._of(spark, None).withColumn("version", F.lit(-1)))
        return self

    def apply(self, batch: DataFrame, number: int) -> None:
        """Changes go into their tables, the newest of a row; then the details of the documents that they name are made anew. A batch that is
        repeated gives the same tables."""
        spark = batch.sparkSession
        rows = written(batch.select(*[c.split()[0] for c in CHANGE.split(", ")]), "changes")
        names = {r.name for r in rows.select("name").distinct().collect()}
        for name, table in self.tables().items():
            if name not in names:
                continue
            told = rows.filter(F.col("name") == name).select(F.from_json("row", table.schema).alias("r"), F.col("op").alias("_op"), F.col("seq").alias("_seq"))
            last = written(store.latest(told.select("r.*", "_op", "_seq"), *table.keys, order="_seq"), "last")
            puts, drops = last.filter("_op = 'put'"), last.filter("_op = 'drop'")
            if name == "documents":
                if not drops.isEmpty():
                    delete_cascading({k: (t,) for k, t in self.tables().items()}, "documents", drops)
                table.exchange(puts, puts, stable=True)
            else:
                table.exchange(last, puts, stable=True)
        ids = written(rows.select(F.col("documentId").alias("id")).distinct(), "ids")
        self.view(spark).exchange(ids, self._of(spark, ids).withColumn("version", F.lit(number)), stable=True)

    def follow(self, spark: SparkSession, source: str, checkpoint: str, files_per_trigger: int | None = None, once: bool = True) -> StreamingQuery:
        """Applies the changes that arrive as Parquet files below `source`."""
        schema = spark.createDataFrame([], CHANGE).schema
        return observed(changes(spark, source, schema, files_per_trigger), self.apply, checkpoint, once)
