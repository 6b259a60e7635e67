"""Letters that arrive are matched with the profiles that are known by then, through an index of the profiles' names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailspan.operators import resolve
from mailspan.operators.textindex import TrigramIndex
from mailspan.sources.buckets import BucketTable
from mailspan.sources.folders import written
from mailspan.streaming.live import changes, observed

#: Names are looked up by stretches of these lengths where they are long enough, else by trigrams.
STRETCHES = (8, 16)
#: A profile's texts as pages of the index.
NAME, ORGANIZATION = 1, 2
TEXTS = "documentId string, pageNumber int, ocrText string"


def texts(profiles: DataFrame) -> DataFrame:
    each = F.array(F.struct(F.lit(NAME).alias("pageNumber"), F.col("name").alias("ocrText")), F.struct(F.lit(ORGANIZATION).alias("pageNumber"), F.col("organization").alias("ocrText")))
    return profiles.select(F.col("id").alias("documentId"), F.explode(each).alias("t")).select("documentId", "t.*")


@dataclass(frozen=True)
class Arrivals:
    """profiles by id, an index of their names and organizations, and links by document."""

    profiles: BucketTable
    index: TrigramIndex
    links: BucketTable
    now: int

    @staticmethod
    def over(spark: SparkSession, path: str, profiles: BucketTable, links: BucketTable, now: int, buckets: int = 32) -> Arrivals:
        """A new index at `path` over the stored profiles."""
        schema = spark.createDataFrame([], TEXTS).schema
        told = BucketTable(f"{path}/texts", ("documentId", "pageNumber"), "documentId", schema, profiles.buckets).create(texts(profiles.read(spark)))
        return Arrivals(profiles, TrigramIndex(f"{path}/index", told, buckets, STRETCHES).build(spark), links, now)

    def learn(self, rows: DataFrame) -> None:
        """Profiles that are new or changed, with their texts and postings; letters that come later are matched with them."""
        rows = written(rows, "profiles")
        self.index.pages.upsert(texts(rows))
        self.index.add(texts(rows))
        self.profiles.upsert(rows)

    def matches(self, party: DataFrame) -> DataFrame:
        """needle, org, id: the same as `resolve.matches` over all profiles, from the index."""
        told = written(resolve.told_needle(party).select(F.col("_needle").alias("needle"), F.col("_org").alias("org")).filter("needle is not null").distinct(), "needles")
        hits = self.index.containing(party.sparkSession, told.select("needle").distinct())
        return told.join(hits, "needle").filter((F.col("pageNumber") == NAME) | F.col("org")).select("needle", "org", F.col("documentId").alias("id")).distinct()

    def take(self, party: DataFrame, number: int) -> None:
        """Links the exact matches of a batch of parties; only candidates' buckets of the profiles are read. Repeated, it links the same."""
        spark = party.sparkSession
        party = written(party, "parties")
        found = written(self.matches(party), "found")
        known = self.profiles.read(spark, self.profiles.touched(found))
        suggested = resolve.suggestions(party, known, found=found)
        self.links.upsert(resolve.auto_links(suggested, self.now))

    def follow(self, spark: SparkSession, source: str, schema, checkpoint: str, files_per_trigger: int | None = None, once: bool = True) -> StreamingQuery:
        return observed(changes(spark, source, schema, files_per_trigger), self.take, checkpoint, once)
