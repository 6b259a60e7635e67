"""The newest documents and their number, kept while documents come, change and go."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailspan.operators import reads, store
from mailspan.sources.buckets import BucketTable
from mailspan.sources.folders import written
from mailspan.streaming.live import changes, observed

#: Of each bucket: its number of documents (place 0) and its newest ones (places 1 to n).
PARTS = "part int, place int, id string, createdAt long, n long"


@dataclass(frozen=True)
class LiveTop:
    """documents in buckets, and of each bucket its newest `newest` rows and its count. A change makes those of its buckets anew, so that a document
    that goes makes room for the next one of its bucket; the whole answer is that of a few rows a bucket."""

    documents: BucketTable
    parts: BucketTable
    newest: int = 10

    @staticmethod
    def over(spark: SparkSession, path: str, documents: BucketTable, newest: int = 10) -> LiveTop:
        parts = BucketTable(path, ("part", "place"), "part", spark.createDataFrame([], PARTS).schema, documents.buckets)
        out = LiveTop(documents, parts, newest)
        parts.create(out._summed(documents.read(spark)))
        return out

    def _summed(self, rows: DataFrame) -> DataFrame:
        own = rows.select(self.documents.bucket_of("id").alias("part"), "id", "createdAt")
        best = own.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(F.desc("createdAt"), "id"))).filter(F.col("place") <= self.newest)
        none = F.lit(None)
        counts = own.groupBy("part").agg(F.count("*").alias("n")).select("part", F.lit(0).alias("place"), none.cast("string").alias("id"), none.cast("long").alias("createdAt"), "n")
        return best.select("part", "place", "id", "createdAt", none.cast("long").alias("n")).unionByName(counts)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Changes (seq, op, and a document's columns): the newest of a document counts."""
        spark = batch.sparkSession
        last = written(store.latest(batch, *self.documents.keys, order="seq"), "last")
        touched = self.documents.exchange(last, last.filter("op = 'put'"), stable=True)
        if touched:
            gone = spark.createDataFrame([(p,) for p in touched], "part int").select("part", F.explode(F.sequence(F.lit(0), F.lit(self.newest))).alias("place"))
            self.parts.exchange(gone, self._summed(self.documents.read(spark, touched)), stable=True)

    def follow(self, spark: SparkSession, source: str, schema, checkpoint: str, files_per_trigger: int | None = None, once: bool = True) -> StreamingQuery:
        return observed(changes(spark, source, schema, files_per_trigger), self.apply, checkpoint, once)

    def top(self, spark: SparkSession) -> DataFrame:
        return reads.recent(self.parts.read(spark).filter("place > 0").select("id", "createdAt"), self.newest)

    def total(self, spark: SparkSession) -> DataFrame:
        return self.parts.read(spark).filter("place = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"))
