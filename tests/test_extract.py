import pytest
from pyspark.sql import functions as F

from mailspan.operators import extract

G1 = """Stadtwerke Musterstadt GmbH
Hauptstraße 12, 80331 München
Tel: 089 1234567
kontakt@stadtwerke-muster.de
Herrn Max Beispiel
Lindenweg 7
10115 Berlin

Datum: 05.03.2024
Kundennummer: K-4711
Betreff: Rechnung für Februar
Sehr geehrte Damen und Herren,
bitte zahlen Sie den Betrag von 1.234,56 € bis zum 20.03.2024.
Die Zahlung erfolgt auf unser Konto.
IBAN DE89 3704 0044 0532 0130 00
Mit freundlichen Grüßen
Stadtwerke Musterstadt GmbH
Kundenservice
Abteilung Abrechnung
Postfach 100
80331 München
Ende"""
G2 = "ACME Widgets\nLine two\nHerrn\nJane Doe\nRoad 5\n12345 Town"
G3 = "Dear customer\nplease find the invoice with this letter\nRegards"


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(1, G1), (2, G2), (3, G3), (4, " \n "), (5, None)], "id int, text string")
    return {r.id: r.asDict(True) for r in extract.extract(df).collect()}


def test_complete_letter(rows):
    r = rows[1]
    assert [(f["fieldName"], f["fieldValue"]) for f in r["fields"]] == [
        ("Sender Organization", "Stadtwerke Musterstadt GmbH"),
        ("Sender Address", "Hauptstraße 12, 80331 München, 80331 München"),
        ("Sender Phone", "089 1234567"),
        ("Sender Email", "kontakt@stadtwerke-muster.de"),
        ("Receiver Name", "Max Beispiel"),
        ("Receiver Address", "Lindenweg 7, 10115 Berlin"),
        ("Subject", "Rechnung für Februar"),
        ("Customer Number", "K-4711"),
        ("IBAN", "DE89370400440532013000"),
        ("Amount", "1.234,56 €"),
        ("Deadline", "20.03.2024"),
        ("Content Preview", "Sehr geehrte Damen und Herren, bitte zahlen Sie den Betrag von 1.234,56 € bis zum 20.03.2024. Die Zahlung erfolgt auf unser Konto."),
    ]
    assert (r["lang"], r["documentType"], r["date"], r["deadline"]) == ("de", "INVOICE", None, "20.03.2024")


def test_lone_salutation(rows):
    r = rows[2]
    assert r["receiver"]["name"] == "Herrn" and r["receiver"]["street"] == "Road 5"
    assert r["sender"]["name"] == "ACME Widgets" and r["sender"]["organization"] is None and r["sender"]["city"] == "Town"


def test_short_english(rows):
    r = rows[3]
    assert r["lang"] == "en" and r["receiver"] is None and r["documentType"] == "INVOICE"
    assert r["fields"][-1]["fieldValue"] == "Dear customer please find the invoice with this letter"


def test_blank_has_nothing(rows):
    for k in (4, 5):
        assert rows[k]["fields"] == [] and rows[k]["sender"] is None and rows[k]["documentType"] is None


@pytest.mark.parametrize(
    "make, text, expected",
    [
        (extract.deadlines, "innerhalb von 14 Tagen", ["14"]),
        (extract.amounts, "EUR 1.234,56 und 99,10 €", ["1.234,56 €", "99,10 €"]),
        (extract.emails, "a@b.de, a@b.de x.y@c.org.", ["a@b.de", "x.y@c.org."]),
        (extract.ibans, "DE89 3704 0044 0532 0130 00", ["DE89370400440532013000"]),
    ],
)
def test_lists(spark, make, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(make("t").alias("x")).first().x == expected


def test_reference_runs_over_lines(spark):
    got = spark.createDataFrame([("Aktenzeichen: AB-12/3\nText",)], "t string").select(extract.references("t").alias("x")).first().x
    assert [tuple(r) for r in got] == [("File Reference (Aktenzeichen)", "AB-12/3\nText")]


def test_fields_keep_their_order(spark):
    df = spark.createDataFrame([(1, G1)], "id int, text string")
    got = extract.fields_long(extract.extract(df), "id").agg(F.max("seq").alias("m"), F.count("*").alias("n")).first()
    assert (got.m, got.n) == (11, 12)


def test_patterns_of_all_texts_do_not_ignore_case(spark):
    """Numbers and spans are looked for in the folded text, by patterns that cost far less there."""
    df = spark.createDataFrame([("x",)], "t string")
    for make in (extract.phones, extract.amounts):
        assert "(?iU)" not in df.select(make("t"))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    "make, text, expected",
    [
        (extract.deadlines, "FRİST: 1.2.2023, frıst 3.2.2023, SPÄTEſTENS 2. MAI 2020", ["1.2.2023", "3.2.2023", "2. MAI 2020"]),
        (extract.phones, "TELEFON 089 123456\nFAX: +49 30 1234567", ["089 123456", "+49 30 1234567"]),
        (extract.amounts, "7,00\neur und ٥,١٢ €, EUR\n\n3,50", ["7,00 €", "٥,١٢ €", "3,50 €"]),
        (extract.emails, None, None),
    ],
)
def test_lists_fold_as_the_patterns_do(spark, make, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(make("t").alias("x")).first().x == expected


def test_references_of_odd_bytes_and_letters(spark):
    df = spark.createDataFrame([("İİİ\nKUNDENNUMMER: A-1 ",), ("ÄÖ Rechnungſ-Nr. R55",)], "text string")
    df = df.union(df.limit(1).selectExpr("cast(concat(unhex('E282FFC3'), encode('\nKundennummer: K-7\n', 'UTF-8')) as string)"))
    got = [r.referenceNumbers for r in extract.extract(df).select("referenceNumbers").collect()]
    assert got == [["A-1"], ["R55"], ["K-7"]]
