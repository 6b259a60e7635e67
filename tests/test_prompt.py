"""Prompts of letters: what `document_prompts` makes of the same rows, from one extraction."""

from pyspark.sql import functions as F

from mailspan.functions.text import trimmed_lines, utrim, words
from mailspan.operators import extract
from mailspan.operators.prompt import document_prompts, letter_prompts
from mailspan.plans import catalogue
from mailspan.sources import views
from tests.helpers import SMALL


def test_letters_are_extracted_once(spark):
    leaves = catalogue.queries()["prompt_text"](spark, SMALL)._jdf.queryExecution().optimizedPlan().collectLeaves()
    # the orders' letters, and the orders' links
    assert sum("o_totalprice" in leaves.apply(i).toString() for i in range(leaves.size())) == 2


def test_letter_prompts_equal_document_prompts(spark):
    own = views.letters(spark, SMALL).limit(20)
    more = spark.createDataFrame([("a", ""), ("b", None), ("c", "one line"), ("d", " \n\n "), ("e", "Rechnung\nTel: 089 12345678\nx\ny\nz")], "documentId string, text string")
    letters = own.union(more).withColumn("title", F.concat(F.lit("T"), "documentId"))
    profiles = spark.createDataFrame([("a", "N", "PERSON", None, None), ("a", "M", "AUTHORITY", "O", "R"), ("e", "N", "PERSON", "P", None)], "documentId string, name string, type string, organization string, reference string")
    got = extract.extract(letters)
    docs = got.select(F.col("documentId").alias("id"), "title", "documentType", F.col("lang").alias("language"))
    pages = letters.select("documentId", F.lit(1).alias("pageNumber"), F.col("text").alias("ocrText"))
    want = document_prompts(docs, pages, extract.fields_long(got, "documentId"), profiles)
    assert sorted(letter_prompts(letters, profiles).collect()) == sorted(want.collect()) and want.count() == 25


def test_lines_and_words_with_odd_spaces(spark):
    odd = [" ", "\t", "\r", "\x0b", "\x85", "\xa0", " ", " ", " ", " ", "　", "\x1c", ""]
    texts = [f"{a}one{b}two{c}\n{a}three\n\n{b}{c}" for a in odd for b in odd for c in ("", " ", "　")]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("odd", F.expr(extract.odd_spaces("t")))
    kept = lambda x: f"filter({x}, w -> w <> '')"
    each = rf"transform(split(t, r'\r\n|\n|\r'), x -> {utrim('x')})"
    got = df.select(F.expr(f"{trimmed_lines('t')} = {each} and {trimmed_lines('t', 'odd')} = {each}").alias("lines"), F.expr(f"{kept(words('t', 'odd'))} = {kept(r"split(t, r'(?U)\s+')")}").alias("words"))
    assert got.distinct().collect() == [(True, True)]
