"""Reads: listings, searches, lookups, and the views that screens show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspan.functions import enums
from mailspan.functions.scalars import percent_text
from mailspan.functions.text import like_any_case


def newest_first(df: DataFrame) -> DataFrame:
    """By createdAt, newest first; equal times by id."""
    return df.orderBy(F.desc("createdAt"), "id")


def recent(documents: DataFrame, n: int = 10) -> DataFrame:
    return newest_first(documents).limit(n)


def by_name(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy("name", "id")


def with_status(documents: DataFrame, status: str) -> DataFrame:
    return newest_first(documents.filter(F.col("status") == status))


def favourites(documents: DataFrame) -> DataFrame:
    return newest_first(documents.filter("isFavorite"))


def by_id(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col("id") == key)


def of_document(df: DataFrame, document: str) -> DataFrame:
    return df.filter(F.col("documentId") == document)


def with_text(documents: DataFrame, pages: DataFrame, query: str) -> DataFrame:
    """Documents of which a page contains the query, each once: a semi join, so that no page is carried or grouped."""
    hits = pages.filter(F.expr(like_any_case("ocrText", query))).select(F.col("documentId").alias("id"))
    return documents.join(hits, "id", "left_semi")


def search(documents: DataFrame, pages: DataFrame, query: str) -> DataFrame:
    """The document list under a search field: all documents while it is blank."""
    return newest_first(documents if not query.strip() else with_text(documents, pages, query))


def search_profiles(profiles: DataFrame, query: str) -> DataFrame:
    return profiles.filter(F.expr(f"{like_any_case('name', query)} or {like_any_case('organization', query)}"))


def similar_profiles(profiles: DataFrame, name: str, organization: str | None) -> DataFrame:
    other = like_any_case("organization", organization) if organization is not None else "false"
    return profiles.filter(F.expr(f"{like_any_case('name', name)} or {other}"))


def profiles_of(profiles: DataFrame, links: DataFrame, document: str) -> DataFrame:
    """Profiles linked with a document, with their role."""
    return profiles.join(links.filter(F.col("documentId") == document).select(F.col("profileId").alias("id"), "role"), "id")


def combined_text(pages: DataFrame, **more: Column) -> DataFrame:
    """documentId, text: the pages' texts in order, an empty line between them; pages without text are left out. more: further aggregates of the pages."""
    got = pages.groupBy("documentId").agg(F.sort_array(F.collect_list(F.when(F.col("ocrText").isNotNull(), F.struct("pageNumber", "ocrText")))).alias("p"), *(v.alias(k) for k, v in more.items()))
    return got.select("documentId", F.array_join(F.col("p.ocrText"), "\n\n").alias("text"), *more)


def page_confidence(pages: DataFrame) -> DataFrame:
    """documentId, n_pages, confidence (`93%`)."""
    return pages.groupBy("documentId").agg(F.count("*").alias("n_pages"), percent_text(F.avg("ocrConfidence")).alias("confidence"))


def detail(documents: DataFrame, pages: DataFrame, fields: DataFrame, events: DataFrame) -> DataFrame:
    """A document a row with its pages, fields and events as sorted arrays (empty where it has none)."""

    def gathered(df: DataFrame, name: str, *columns: str, reverse: bool = False) -> DataFrame:
        return df.groupBy(F.col("documentId").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*columns)), asc=not reverse).alias(name))

    out = documents.join(gathered(pages, "pages", "pageNumber", "ocrText"), "id", "left")
    out = out.join(gathered(fields, "fields", "seq", "fieldName", "fieldValue", "fieldType", "confidence"), "id", "left")
    out = out.join(gathered(events, "events", "createdAt", "id", "eventType", "title", reverse=True), "id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("pages", "fields", "events")})


SECTIONS = {
    "sender": "startswith(fieldName, 'Sender')",
    "receiver": "startswith(fieldName, 'Receiver')",
    "metadata": "fieldType in ('DATE', 'SUBJECT', 'REFERENCE_NUMBER', 'DEADLINE')",
    "financial": "fieldType = 'IBAN' or fieldName = 'Amount'",
    "contact": "fieldType in ('EMAIL', 'PHONE') and not startswith(fieldName, 'Sender') and not startswith(fieldName, 'Receiver')",
    "content": "fieldType = 'TEXT'",
}


def field_sections(fields: DataFrame) -> DataFrame:
    """Each field once for each section that shows it; sections overlap, and some fields are in none."""
    names = ", ".join(f"if({c}, '{k}', null)" for k, c in SECTIONS.items())
    return fields.withColumn("section", F.explode(F.expr(f"filter(array({names}), x -> x is not null)")))


def suggestions_by_state(suggestions: DataFrame) -> DataFrame:
    """`auto_linked` or `active`, and whether an exact match still has to be linked."""
    return suggestions.withColumn("state", F.when(F.col("isAutoLinked"), "auto_linked").otherwise("active")).withColumn("to_link", (F.col("matchType") == "EXACT_MATCH") & ~F.col("isAutoLinked"))


DOMAIN = ("id", "title", "status", "documentType", "language", "sourceType", "thumbnailPath", "pageCount", "isFavorite", "createdAt", "modifiedAt")


def to_domain(documents: DataFrame) -> DataFrame:
    """Stored documents as screens know them: an unknown type is none, an unknown status or source an error; how a row is synchronised is not told."""
    known = {"status": enums.strict(F.col("status"), enums.DOCUMENT_STATUS), "documentType": enums.or_null(F.col("documentType"), enums.DOCUMENT_TYPE), "sourceType": enums.strict(F.col("sourceType"), enums.SOURCE_TYPE)}
    return documents.select(*[known.get(c, F.col(c)).alias(c) for c in DOMAIN])


def to_entity(domain: DataFrame) -> DataFrame:
    """The way back: what the domain does not know is as in a new row."""
    return domain.select(*DOMAIN, F.lit("LOCAL").alias("syncStatus"))


def fields_to_domain(fields: DataFrame) -> DataFrame:
    """Stored fields; an unknown type of field is OTHER."""
    return fields.withColumn("fieldType", enums.or_default(F.col("fieldType"), enums.FIELD_TYPE, "OTHER"))


def state_of(rows: DataFrame, error: str | None = None) -> tuple[str, str | None]:
    """What a list shows: `Error`, `Empty` or `Success`."""
    if error is not None:
        return "Error", error
    return ("Empty" if rows.isEmpty() else "Success"), None

