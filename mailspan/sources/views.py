"""Mail tables as views of the star schema that the driver provides, so that every operator runs on given rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspan.functions import enums
from mailspan.functions.text import lines
from mailspan.sources.folders import spread

PAGE_LINES = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(domain: tuple[str, ...], n: str) -> str:
    return "element_at(array(" + ", ".join(f"'{x}'" for x in domain) + f"), cast(({n}) % {len(domain)} as int) + 1)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.drop("text").join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"),
        F.expr("concat(if(doc_id % 2 = 0, 'Scan ', 'Letter '), doc_id)").alias("title"),
        F.expr(_pick(enums.DOCUMENT_STATUS, "doc_id")).alias("status"),
        F.expr(f"if(doc_id % 9 = 8, null, {_pick(enums.DOCUMENT_TYPE, 'doc_id % 9')})").alias("documentType"),
        F.col("lang").alias("language"),
        F.expr(_pick(enums.SOURCE_TYPE, "doc_id")).alias("sourceType"),
        F.lit(None).cast("string").alias("thumbnailPath"),
        F.lit(1).alias("pageCount"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("isFavorite"),
        (F.col("doc_id") * 60000).alias("createdAt"),
        (F.col("doc_id") * 60000).alias("modifiedAt"),
        F.lit("LOCAL").alias("syncStatus"),
    )


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = table(spark, sf_dir, "documents").select("doc_id", F.expr(lines("text")).alias("l"))
    pages = F.expr(rf"transform(sequence(0, (size(l) - 1) div {PAGE_LINES}), i -> array_join(slice(l, cast(i as int) * {PAGE_LINES} + 1, {PAGE_LINES}), '\n'))")
    return split.select("doc_id", F.posexplode(pages).alias("p", "ocrText")).select(
        F.expr("concat(doc_id, '-', p + 1)").alias("id"),
        F.col("doc_id").cast("string").alias("documentId"),
        (F.col("p") + 1).alias("pageNumber"),
        F.expr("concat('page-', doc_id, '-', p + 1, '.jpg')").alias("imagePath"),
        F.lit(None).cast("string").alias("processedPath"),
        "ocrText",
        F.expr("cast((80 + (doc_id + p) % 20) / 100D as float)").alias("ocrConfidence"),
        F.lit(2480).alias("width"),
        F.lit(3508).alias("height"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons, suppliers as authorities; inserted in the order of their keys, customers first."""
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n_nationkey"), F.lit("PERSON").alias("type"), F.lit(None).cast("string").alias("organization"), F.lit("c").alias("p"), F.lit(0).alias("o"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("n_nationkey"), F.lit("AUTHORITY").alias("type"), F.col("s_name").alias("organization"), F.lit("s").alias("p"), F.lit(1).alias("o"))
    return c.union(s).join(nation, "n_nationkey").select(
        F.expr("concat(p, k)").alias("id"), "type", "name", "organization", F.col("n_name").alias("city"),
        F.expr("if(k % 3 = 0, null, concat(p, k, '@example.com'))").alias("email"), F.expr("if(k % 4 = 0, null, concat('089 ', k))").alias("phone"),
        F.expr("o * 1000000000L + k").alias("createdAt"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as string) as documentId", "concat('c', o_custkey) as profileId", "'RECEIVER' as role")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct().selectExpr("cast(l_orderkey as string) as documentId", "concat('s', l_suppkey) as profileId", "'SENDER' as role")  # numbers are told apart, not text
    return o.union(li)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("documentId"), F.upper("event_type").alias("eventType"),
        F.expr("concat('Event ', event_type)").alias("title"), F.col("props").alias("data"), F.unix_millis(F.col("ts").cast("timestamp")).alias("createdAt"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.expr("concat(conv_id, '-', turn)").alias("id"), F.col("conv_id").cast("string").alias("conversationId"), F.upper("role").alias("role"), F.col("text").alias("content"), F.col("turn").alias("createdAt"))


# The letter's lines by kind (order key modulo 6).
SUBJECTS = ("Ihre Rechnung", "Zweite Mahnung", "Ihr Bescheid", "Ihr Antrag", "Ihr Vertrag", "Ihr Zeugnis")
CLOSING = ("Mit freundlichen Grüßen", "Kundenservice", "Abteilung Post", "Leitung", "Buchhaltung", "Archiv", "Kopie", "Ende")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A German business letter for each order: documentId, text."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    rows = rows.select(F.col("o_orderkey").cast("string").alias("documentId"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "n_name")
    rows = spread(rows, "documentId")  # narrow rows: the texts are made after it; by the column on which letters are joined and grouped
    kind = "cast(o_orderkey % 6 as int)"
    body = [
        "'Stadtwerke Musterstadt GmbH'", "'Hauptstraße 12'", "concat('Tel: 089 ', lpad(cast(o_orderkey as string), 7, '0'))", "concat('kontakt', o_custkey, '@example.com')",
        "concat('Herrn Kunde ', translate(cast(o_custkey as string), '0123456789', 'abcdefghij'))", "concat('Weg ', o_custkey % 90 + 1)", "concat('1', lpad(cast(o_custkey % 10000 as string), 4, '0'), ' ', n_name)", "''",
        "concat('Datum ', date_format(o_orderdate, 'dd.MM.yyyy'))",
        f"if({kind} < 2, concat('Rechnungsnummer: R-', lpad(cast(o_orderkey as string), 6, '0')), concat('Kundennummer: K-', lpad(cast(o_custkey as string), 6, '0')))",
        f"concat('Betreff: ', element_at(array({', '.join(repr(s) for s in SUBJECTS)}), {kind} + 1))", "'Sehr geehrte Damen und Herren,'",
        "concat('bitte zahlen Sie EUR ', replace(cast(cast(o_totalprice as decimal(18,2)) as string), '.', ','), ' bis zum ', date_format(date_add(cast(o_orderdate as date), 30), 'dd.MM.yyyy'))",
        f"if({kind} < 2, concat('IBAN DE89 3704 0044 0532 ', lpad(cast(o_orderkey % 10000 as string), 4, '0'), ' 00'), 'Vielen Dank im Voraus')",
        *(f"'{x}'" for x in CLOSING),
    ]
    return rows.select("documentId", F.expr(f"array_join(array({', '.join(body)}), '\\n')").alias("text"))
