"""Where queries are registered with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, *, tables: bool = True) -> Callable[[Query], Query]:
    """Register a function as a query of its name, with its SQL over the canonical tables."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            head = f"WITH RECURSIVE {A.SQL}" if tables else ""
            _SQL[f.__name__] = f"{head}, {body[5:]}" if tables and body.upper().startswith("WITH ") else f"{head} {body}" if tables else body.replace("WITH ", "WITH RECURSIVE ", 1) if body.startswith("WITH ") else body
        return f

    return register


def queries() -> dict[str, Query]:
    """Every query by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query."""
    return dict(_SQL)
