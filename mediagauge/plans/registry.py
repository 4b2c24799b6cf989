"""The registered queries of the core and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules with a QUERIES dict and an SQL dict.
MODULES = ("timestamps", "profiles", "texts", "clusters", "evaluation", "selection", "stories", "checks", "streams")


def queries() -> dict[str, Query]:
    """Name to query, each called with the session and the folder of the tables."""
    out: dict[str, Query] = {}
    for name in MODULES:
        for key, query in import_module(f"mediagauge.plans.{name}").QUERIES.items():
            if key in out:
                raise ValueError(f"query {key} is registered twice")
            out[key] = query
    return out


def oracle_sql() -> dict[str, str]:
    """Name to equivalent SQL, for the queries that SQL can express."""
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(import_module(f"mediagauge.plans.{name}").SQL)
    return out
