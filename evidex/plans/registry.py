"""Every query of the engine by name, with its SQL: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    for module in ("retrieval", "evidence", "ledger", "session", "more", "store"):
        import_module(f"{__package__}.{module}_queries")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
