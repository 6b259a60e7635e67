"""Live views: a stream of changes triggers re-evaluation of batch queries, and event logs take each event once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from mailspan.sources.folders import dealt, written


def changes(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """The stream of Parquet files that arrive below `path`."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def guarded(refresh: Callable[[DataFrame, int], None], failed: Callable[[str], None]) -> Callable[[DataFrame, int], None]:
    """`refresh` that reports an error instead of ending the stream."""

    def run(batch: DataFrame, number: int) -> None:
        try:
            refresh(batch, number)
        except Exception as e:  # the view shows it as its state
            failed(f"{type(e).__name__}: {e}")

    return run


def observed(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Calls `refresh` with each batch of changes: with `once` for all that is there, else as changes come."""
    writer = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def view_writer(query: Callable[[], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A refresh that evaluates a whole batch query anew and writes it as the version of that batch; a batch that is
    repeated after a failure overwrites its own version only."""

    def refresh(batch: DataFrame, number: int) -> None:
        query().write.mode("overwrite").parquet(f"{path}/version={number}")

    return refresh


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last version that was written."""
    every = spark.read.parquet(path)
    last = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == last).drop("version")


def log_events(stream: DataFrame, path: str, checkpoint: str, once: bool = True, buckets: int = 32, remembered: str = "1 hour") -> StreamingQuery:
    """Appends events to the log at `path`, each id once, however often it is sent or a batch is repeated.

    Repeats that arrive within `remembered` are dropped by the stream's own state, which forgets ids after that time of arrival (not of the
    event: no event is ever too late). For older repeats a batch is compared with the log: with the buckets of its own ids alone.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = written(batch.drop("_arrived").dropDuplicates(["id"]).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")), "events")
        of = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most `buckets` numbers
        if not of:
            return
        known = logged(spark, path, fresh.schema)
        if known is not None:
            known = known.filter(F.col("bucket").isin(of) & (F.col("batch") != number)).select("bucket", "id")
            fresh = fresh.join(known, ["bucket", "id"], "left_anti")
        # a batch that is repeated after a failure overwrites its own folders only
        rows = dealt(fresh.withColumn("batch", F.lit(number)), "bucket")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)

    once_each = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", remembered).dropDuplicatesWithinWatermark(["id"])
    return observed(once_each, append, checkpoint, once)


def logged(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The log's rows with their `bucket` and `batch`; none before its first batch."""
    try:
        own = StructType([f for f in schema if f.name not in ("bucket", "batch")])
        return spark.read.schema(StructType([*own, StructField("bucket", IntegerType()), StructField("batch", LongType())])).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def with_progress(work: Callable[[DataFrame], DataFrame], path: str, total: int) -> Callable[[DataFrame, int], None]:
    """A refresh that writes what `work` makes of each batch, and beside it how far the whole job is: batch, rows, done, share. Rows are counted by the
    job that writes them, so that no second pass is needed; a batch that is repeated replaces its own rows."""

    def refresh(batch: DataFrame, number: int) -> None:
        spark, seen = batch.sparkSession, Observation(f"batch-{number}")
        work(batch).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        rows = seen.get["rows"]
        before = progress_of(spark, path)
        done = rows + (0 if before is None else before.filter(F.col("batch") < number).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
        told = spark.createDataFrame([(rows, done, done / max(1, total))], "rows long, done long, share double")
        told.write.mode("overwrite").parquet(f"{path}/progress/batch={number}")

    return refresh


def progress_of(spark: SparkSession, path: str) -> DataFrame | None:
    """Progress of a job by batch; none before its first batch has ended."""
    try:
        return spark.read.schema("rows long, done long, share double, batch long").parquet(f"{path}/progress")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_states(stream: DataFrame, key: str = "documentId", state: str = "state", time: str = "ts") -> DataFrame:
    """The newest state of each key, conflated: a streaming aggregate for update or complete mode."""
    return stream.groupBy(key).agg(F.max_by(state, time).alias(state), F.max(time).alias(time))


class LatestQuery:
    """Runs a stream for the newest parameter only: a new one stops the query of the old one."""

    def __init__(self, start: Callable[[str], StreamingQuery]):
        self._start, self._running = start, None
        self.parameter: str | None = None

    def use(self, parameter: str) -> StreamingQuery:
        if self._running is not None and self._running.isActive:
            if parameter == self.parameter:
                return self._running
            self._running.stop()
        self.parameter, self._running = parameter, self._start(parameter)
        return self._running

    def close(self) -> None:
        if self._running is not None and self._running.isActive:
            self._running.stop()
