"""All queries of the core: name to callable, and name to SQL."""

from __future__ import annotations

from . import extract_queries, kb_queries, nested_queries, prep_queries, span_queries

FLAGSHIP = "ensemble_vote"
QUERIES: dict = {}
SQL: dict = {}
for _module in (nested_queries, kb_queries, span_queries, prep_queries, extract_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
