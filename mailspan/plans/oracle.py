"""The views of `mailspan.sources.views` in SQL, for checking queries against another engine."""

from __future__ import annotations

from mailspan.functions import enums
from mailspan.sources.views import CLOSING, PAGE_LINES, SUBJECTS


def _pick(domain: tuple[str, ...], n: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in domain) + f"][({n}) % {len(domain)} + 1]"


DOCUMENTS = f"""d AS (
  SELECT x.doc_id::VARCHAR AS id, (CASE WHEN x.doc_id % 2 = 0 THEN 'Scan ' ELSE 'Letter ' END) || x.doc_id AS title,
    {_pick(enums.DOCUMENT_STATUS, "x.doc_id")} AS status, CASE WHEN x.doc_id % 9 = 8 THEN NULL ELSE {_pick(enums.DOCUMENT_TYPE, "x.doc_id % 9")} END AS documentType,
    x.lang AS language, {_pick(enums.SOURCE_TYPE, "x.doc_id")} AS sourceType, coalesce(l.quality = 1, false) AS isFavorite, x.doc_id * 60000 AS createdAt
  FROM documents x LEFT JOIN labels l ON x.doc_id = l.doc_id)"""
PAGES = f"""pg AS (
  SELECT doc_id::VARCHAR AS documentId, p + 1 AS pageNumber, array_to_string(l[p * {PAGE_LINES} + 1 : p * {PAGE_LINES} + {PAGE_LINES}], chr(10)) AS ocrText,
    ((80 + (doc_id + p) % 20) / 100.0)::FLOAT AS ocrConfidence
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(0, (len(l) - 1) // {PAGE_LINES} + 1)) AS p))"""
PROFILES = """pr AS (
  SELECT p || k AS id, type, name, organization, n_name AS city, CASE WHEN k % 3 = 0 THEN NULL ELSE p || k || '@example.com' END AS email,
    CASE WHEN k % 4 = 0 THEN NULL ELSE '089 ' || k END AS phone, o * 1000000000 + k AS createdAt
  FROM (SELECT c_custkey AS k, c_name AS name, c_nationkey AS nk, 'PERSON' AS type, NULL::VARCHAR AS organization, 'c' AS p, 0 AS o FROM customer
        UNION ALL SELECT s_suppkey, s_name, s_nationkey, 'AUTHORITY', s_name, 's', 1 FROM supplier) JOIN nation ON nk = n_nationkey)"""
LINKS = """ln AS (
  SELECT o_orderkey::VARCHAR AS documentId, 'c' || o_custkey AS profileId, 'RECEIVER' AS role FROM orders
  UNION SELECT DISTINCT l_orderkey::VARCHAR, 's' || l_suppkey, 'SENDER' FROM lineitem)"""
TIMELINE = """tl AS (
  SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS documentId, upper(event_type) AS eventType, 'Event ' || event_type AS title, props AS data, epoch_us(ts) // 1000 AS createdAt FROM events)"""
_LINES = [
    "'Stadtwerke Musterstadt GmbH'", "'Hauptstraße 12'", "'Tel: 089 ' || lpad(o_orderkey::VARCHAR, 7, '0')", "'kontakt' || o_custkey || '@example.com'",
    "'Herrn Kunde ' || translate(o_custkey::VARCHAR, '0123456789', 'abcdefghij')", "'Weg ' || (o_custkey % 90 + 1)", "'1' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || ' ' || n_name", "''",
    "'Datum ' || strftime(o_orderdate, '%d.%m.%Y')", "CASE WHEN k < 2 THEN 'Rechnungsnummer: R-' || lpad(o_orderkey::VARCHAR, 6, '0') ELSE 'Kundennummer: K-' || lpad(o_custkey::VARCHAR, 6, '0') END",
    "'Betreff: ' || subject", "'Sehr geehrte Damen und Herren,'",
    "'bitte zahlen Sie EUR ' || replace(o_totalprice::DECIMAL(18,2)::VARCHAR, '.', ',') || ' bis zum ' || strftime(o_orderdate::DATE + 30, '%d.%m.%Y')",
    "CASE WHEN k < 2 THEN 'IBAN DE89 3704 0044 0532 ' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || ' 00' ELSE 'Vielen Dank im Voraus' END",
    *(f"'{x}'" for x in CLOSING),
]
#: Letters by their source columns: o_orderkey, o_custkey, n_name, k (kind), subject, amount, due, sent, text.
LETTERS = f"""lt AS (
  SELECT *, concat_ws(chr(10), {", ".join(_LINES)}) AS text, replace(o_totalprice::DECIMAL(18,2)::VARCHAR, '.', ',') AS amount,
    strftime(o_orderdate::DATE + 30, '%d.%m.%Y') AS due, strftime(o_orderdate, '%d.%m.%Y') AS sent, o_orderkey::VARCHAR AS documentId
  FROM (SELECT *, o_orderkey % 6 AS k, [{", ".join(repr(s) for s in SUBJECTS)}][o_orderkey % 6 + 1] AS subject FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey))"""


def fold(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def sql(select: str, *views: str) -> str:
    return f"WITH {', '.join(views)} {select}" if views else select
