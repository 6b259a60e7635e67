import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mailspan.functions import enums, scalars
from mailspan.operators import reads, store
from mailspan.sources import ingest
from mailspan.sources.schemas import SCHEMAS


def test_like(spark):
    df = spark.createDataFrame([("1", "ÄB 50% a\\b"), ("2", "äb"), ("3", None), ("4", "Straße_1")], "documentId string, ocrText string")
    docs = spark.createDataFrame([(str(i), i) for i in range(1, 5)], "id string, createdAt long")
    hits = lambda q: [r.id for r in reads.search(docs, df, q).collect()]
    assert hits("ÄB") == ["1"] and hits("äb") == ["2"] and hits("b") == ["2", "1"]
    assert hits("50%B") == ["1"] and hits("a\\b") == ["1"] and hits("e_1") == ["4"] and hits("") == ["4", "3", "2", "1"]


def test_equal_times_by_id(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "id string, createdAt long")
    assert [r.id for r in reads.newest_first(df).collect()] == ["c", "a", "b"]


def test_insert_again_takes_children(spark):
    docs = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, title string")
    pages = spark.createDataFrame([("p", "1"), ("q", "2")], "id string, documentId string")
    out = store.insert_cascading({"documents": docs, "document_pages": pages}, "documents", spark.createDataFrame([("1", "new")], "id string, title string"))
    assert sorted(map(tuple, out["documents"].collect())) == [("1", "new"), ("2", "y")]
    assert [r.id for r in out["document_pages"].collect()] == ["q"]
    assert sorted(map(tuple, store.update(docs, spark.createDataFrame([("1", "u"), ("9", "z")], "id string, title string")).collect())) == [("1", "u"), ("2", "y")]


def test_fields(spark):
    f = spark.createDataFrame([("a", "1", "n", "v", "TEXT", 0.5, None, False, 0)], SCHEMAS["extracted_data"])
    assert store.confirm_field(f, "a").first().isConfirmed
    assert store.edit_field(f, "a", "m", "w").first().fieldValue == "w"
    assert store.add_field(f, "1", " x ", " y ").count() == 2 and store.add_field(f, "1", " ", "y").count() == 1
    assert store.delete_field(f, "a").isEmpty()
    assert store.delete_fields_of(f, spark.createDataFrame([("1",)], "documentId string")).isEmpty()


def test_enums(spark):
    df = spark.createDataFrame([("NEW",), ("?",), (None,)], "s string")
    assert [r.x for r in df.select(enums.or_null(F.col("s"), enums.DOCUMENT_STATUS).alias("x")).collect()] == ["NEW", None, None]
    assert [r.x for r in df.select(enums.or_default(F.col("s"), enums.DOCUMENT_STATUS, "OLD").alias("x")).collect()] == ["NEW", "OLD", "OLD"]
    with pytest.raises(PySparkException):
        df.select(enums.strict(F.col("s"), enums.DOCUMENT_STATUS)).collect()


def test_forms(spark):
    df = spark.createDataFrame([(" ", " ACME ", "", "  "), ("Ann", None, "x@y", "France")], "name string, organization string, email string, country string")
    assert [tuple(r) for r in store.form_profiles(df).collect()] == [(" ACME ", " ACME ", None, "Germany"), ("Ann", None, "x@y", "France")]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    now = 1_700_000_000_000
    assert [value(scalars.relative_time(F.lit(now - s * 1000), F.lit(now))) for s in (59, 60, 3600, 86400)] == ["Just now", "1 min ago", "1h ago", "1d ago"]
    assert value(scalars.percent_text(F.lit(0.925))) == "93%" and value(scalars.percent_text(F.lit(None))) == "NaN%"
    assert [value(scalars.percent(F.lit(x))) for x in (0.7, 0.75, 0.8, 0.85, 0.9, 0.92, 0.95)] == [70, 75, 80, 85, 90, 92, 95]
    assert bytes(value(scalars.pcm16(F.array(F.lit(0.0), F.lit(1.0), F.lit(-2.0), F.lit(0.5))))) == b"\x00\x00\xff\x7f\x01\x80\xff\x3f"
    assert value(scalars.speech_tokens(F.lit("Az .!?,#"))) == [43, 68, 16, 4, 5, 6, 3, 0]
    assert value(scalars.phonemes(F.lit("aſ"))) == [97, 255] and value(scalars.is_arabic(F.lit("xكy"))) and not value(scalars.is_arabic(F.lit("x")))
    assert value(scalars.a4_layout(F.lit(0), F.lit(10))) is None and round(value(scalars.a4_layout(F.lit(1190), F.lit(100))).scale, 3) == 0.5


def test_ingest(spark):
    blocks = spark.createDataFrame([("d", 1, 0, "a", [0.5, None]), ("d", 1, 1, "b", [1.0]), ("e", 1, 0, "", [None]), ("f", 1, 0, "", [])], "document_id string, page_number int, block int, text string, confidences array<double>")
    got = {r.document_id: (r.ocr_text, r.confidence) for r in ingest.recognised(blocks).collect()}
    assert got["d"] == ("a\nb", 0.75) and got["e"][1] != got["e"][1] and got["f"][1] == 0
    stored = spark.createDataFrame([("theme", "PINK"), ("auto_process", "no!"), ("biometric", "true")], "key string, value string")
    assert tuple(ingest.preferences(stored).first()) == ("SYSTEM", True, "de", True, True, None)
    assert ingest.set_preference(stored, "theme", None).count() == 2 and ingest.set_preference(stored, "x", "1").count() == 4
    scans = spark.createDataFrame([("s", [str(i) for i in range(12)])], "id string, uris array<string>")
    assert ingest.scanned_pages(scans).count() == 10


def test_float_rows(spark, tmp_path):
    import numpy as np

    (tmp_path / "v.bin").write_bytes(np.arange(512, dtype="<f4").tobytes())
    rows = ingest.float_rows(spark, str(tmp_path)).orderBy("row").collect()
    assert len(rows) == 2 and rows[1]["values"][0] == 256.0
