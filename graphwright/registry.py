"""All registered queries and their SQL, collected from the query modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "a10_certified_edges"
#: Modules whose import registers queries.
MODULES = ("text", "layout", "graph", "joins", "review", "scoring", "ledger", "ordered", "edits", "totals", "kernel", "graph_edit", "parsing", "selection", "binding", "facts", "source", "guards", "index", "reading", "agreement", "evaluation", "document")

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, folder of the tables) -> DataFrame, with DuckDB SQL if it has any."""

    def keep(function: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = function
        if sql:
            _sql[name] = sql
        return function

    return keep


def _load() -> None:
    for name in MODULES:
        import_module(f"graphwright.plans.{name}_queries")


def queries() -> dict[str, Query]:
    """Query by name."""
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    _load()
    return dict(_sql)
