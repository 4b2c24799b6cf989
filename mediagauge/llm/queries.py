"""The queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "similarity_queries",
    "contributor_queries",
    "consensus_queries",
    "line_queries",
    "truncation_queries",
    "token_queries",
    "leakage_queries",
    "abuse_queries",
)

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"mediagauge.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
