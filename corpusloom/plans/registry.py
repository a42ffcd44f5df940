"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from corpusloom.plans import check_queries, mirror_queries, package_queries, rule_queries, span_queries, text_queries

_MODULES = (mirror_queries, span_queries, text_queries, check_queries, package_queries, rule_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
