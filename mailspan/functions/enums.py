"""Closed domains of the mail tables and their three ways of being parsed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in ordinal order.
DOCUMENT_STATUS = ("NEW", "PROCESSING", "EXTRACTED", "REVIEWED", "ARCHIVED")
DOCUMENT_TYPE = ("OFFICIAL_LETTER", "INVOICE", "NOTICE", "FORM", "CONTRACT", "CERTIFICATE", "RECEIPT", "OTHER")
SOURCE_TYPE = ("CAMERA", "UPLOAD", "PDF_IMPORT")
FIELD_TYPE = ("TEXT", "DATE", "ADDRESS", "REFERENCE_NUMBER", "PERSON_NAME", "ORGANIZATION", "PHONE", "EMAIL", "IBAN", "SUBJECT", "DEADLINE", "TAG_SUGGESTION", "OTHER")
PROFILE_TYPE = ("AUTHORITY", "PERSON", "FAMILY_MEMBER", "USER_SELF")
PROFILE_ROLE = ("SENDER", "RECEIVER", "SUBJECT", "CASE_WORKER", "RELATED")
THEME = ("LIGHT", "DARK", "SYSTEM")


def strict(column: Column, domain: tuple[str, ...]) -> Column:
    """Unknown values are errors; null stays null."""
    return F.when(column.isNull() | column.isin(*domain), column).otherwise(F.raise_error(F.concat(F.lit("unknown value: "), column)))


def or_null(column: Column, domain: tuple[str, ...]) -> Column:
    return F.when(column.isin(*domain), column)


def or_default(column: Column, domain: tuple[str, ...], default: str) -> Column:
    return F.when(column.isin(*domain), column).otherwise(F.lit(default))
