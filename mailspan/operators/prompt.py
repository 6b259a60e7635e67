"""Prompts for a chat about a document, assembled from its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspan.functions.scalars import PAGE_BREAK, PROMPT_HEAD, PROMPT_INSTRUCTIONS, percent
from mailspan.operators.extract import extract


def _field_line(name: Column, value: Column, kind: Column, confidence: Column) -> Column:
    return F.concat(F.lit("- "), name, F.lit(": "), value, F.lit(" ("), kind, F.lit(", confidence: "), percent(confidence).cast("string"), F.lit("%)"))


def _known(profiles: DataFrame) -> DataFrame:
    """id, p: the lines of each document's profiles, by their names."""
    own = F.array_join(F.filter(F.array(F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit(")")), F.concat(F.lit("  Organization: "), "organization"), F.concat(F.lit("  Reference: "), "reference")), lambda x: x.isNotNull()), "\n")
    known = profiles.select("documentId", "name", own.alias("line")).groupBy(F.col("documentId").alias("id")).agg(F.sort_array(F.collect_list(F.struct("name", "line"))).alias("p"))
    return known.select("id", F.col("p.line").alias("p"))


def document_prompts(documents: DataFrame, pages: DataFrame, fields: DataFrame, profiles: DataFrame) -> DataFrame:
    """id, prompt. Sections without rows are left out, and so is a text that is blank.

    documents: id, title, documentType, language; pages: documentId, pageNumber, ocrText; fields: documentId, seq,
    fieldName, fieldValue, fieldType, confidence; profiles: documentId, name, type, organization, reference.
    """
    line = _field_line(F.col("fieldName"), F.col("fieldValue"), F.col("fieldType"), F.col("confidence"))
    told = fields.select("documentId", "seq", line.alias("line")).groupBy(F.col("documentId").alias("id")).agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("f"))
    text = pages.filter("ocrText is not null").groupBy(F.col("documentId").alias("id")).agg(F.sort_array(F.collect_list(F.struct("pageNumber", "ocrText"))).alias("t"))
    w = documents.join(told, "id", "left").join(_known(profiles), "id", "left").join(text, "id", "left")
    return _assembled(w.withColumn("f", F.col("f.line")).withColumn("full", F.array_join(F.col("t.ocrText"), PAGE_BREAK)))


def letter_prompts(letters: DataFrame, profiles: DataFrame) -> DataFrame:
    """The same for letters (documentId, title, text) that are not stored yet: each is extracted once, after its profiles have come to it, so that neither
    its fields nor its prompt are shuffled."""
    w = extract(letters.withColumnRenamed("documentId", "id").join(_known(profiles), "id", "left"))
    w = w.select("id", "title", "documentType", F.col("lang").alias("language"), "fields", "p", F.col("text").alias("full"))
    line = lambda x: _field_line(x["fieldName"], x["fieldValue"], x["fieldType"], x["confidence"])
    return _assembled(w.withColumn("f", F.transform("fields", line)))


def _assembled(w: DataFrame) -> DataFrame:
    lines = F.flatten(
        F.array(
            F.array(*map(F.lit, PROMPT_HEAD), F.lit(""), F.lit("## Current Document"), F.concat(F.lit("Title: "), "title")),
            F.when(F.col("documentType").isNotNull(), F.array(F.concat(F.lit("Type: "), "documentType"))).otherwise(F.array().cast("array<string>")),
            F.when(F.col("language").isNotNull(), F.array(F.concat(F.lit("Language: "), "language"))).otherwise(F.array().cast("array<string>")),
            F.array(F.lit("")),
            F.when(F.size("f") > 0, F.concat(F.array(F.lit("## Extracted Information")), F.col("f"), F.array(F.lit("")))).otherwise(F.array().cast("array<string>")),
            F.when(F.size("p") > 0, F.concat(F.array(F.lit("## Related Profiles")), F.col("p"), F.array(F.lit("")))).otherwise(F.array().cast("array<string>")),
            F.when(F.trim("full") != "", F.array(F.lit("## Document Full Text"), F.col("full"))).otherwise(F.array().cast("array<string>")),
            F.array(F.lit(""), *map(F.lit, PROMPT_INSTRUCTIONS), F.lit("")),
        )
    )
    return w.select("id", F.array_join(lines, "\n").alias("prompt"))
