"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from mailspan.llm import ann, collocations, jaccard, langid, lines, mixing, packing, pii, quality, sharding, trie, warc, winnow

MODULES = (sharding, langid, warc, quality, pii, mixing, ann, packing, jaccard, lines, collocations, winnow, trie)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in getattr(m, "ORACLE_SQL", {}).items()}
