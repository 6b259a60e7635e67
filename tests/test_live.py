from pyspark.sql import functions as F

from mailspan.sources.schemas import SCHEMAS
from mailspan.streaming import live


def _event(spark, *ids):
    return spark.createDataFrame([(i, "d", "X", "t", None, None, None, None, 1) for i in ids], SCHEMAS["timeline_events"])


def test_log_takes_each_event_once(spark, tmp_path):
    src, log, ck = (str(tmp_path / x) for x in ("src", "log", "ck"))
    _event(spark, "a", "b", "a").write.parquet(src)
    run = lambda: live.log_events(live.changes(spark, src, SCHEMAS["timeline_events"]), log, ck).awaitTermination()
    run()
    _event(spark, "b", "c").write.mode("append").parquet(src)
    run()
    assert sorted(r.id for r in spark.read.parquet(log).collect()) == ["a", "b", "c"]


def test_view_follows_changes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    errors = []
    _event(spark, "a").write.parquet(src)
    refresh = live.guarded(live.view_writer(lambda: spark.read.parquet(src).agg(F.count("*").alias("n")), out), errors.append)
    run = lambda: live.observed(live.changes(spark, src, SCHEMAS["timeline_events"]), refresh, ck).awaitTermination()
    run()
    assert live.newest_version(spark, out).first().n == 1
    _event(spark, "b").write.mode("append").parquet(src)
    run()
    assert live.newest_version(spark, out).first().n == 2 and not errors


def test_errors_are_reported(spark, tmp_path):
    src, errors = str(tmp_path / "src"), []
    _event(spark, "a").write.parquet(src)

    def broken(batch, number):
        raise ValueError("no")

    live.observed(live.changes(spark, src, SCHEMAS["timeline_events"]), live.guarded(broken, errors.append), str(tmp_path / "ck")).awaitTermination()
    assert errors == ["ValueError: no"]


def test_latest_states_and_parameter(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("d", "A", 1), ("d", "B", 2), ("e", "A", 1)], "documentId string, state string, ts long").write.parquet(src)
    started = []

    def start(name):
        started.append(name)
        states = live.latest_states(spark.readStream.schema("documentId string, state string, ts long").parquet(src))
        return states.writeStream.format("memory").queryName(f"q_{name}").outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()

    q = live.LatestQuery(start)
    q.use("one")
    q.use("one")
    q.use("two").processAllAvailable()
    got = {r.documentId: r.state for r in spark.table("q_two").collect()}
    q.close()
    assert started == ["one", "two"] and got == {"d": "B", "e": "A"}
