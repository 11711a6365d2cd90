"""All queries of the library with their SQL, by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under an operator id, with SQL for the same result where there is any."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def oracle_of(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _SQL[name]


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from importlib import import_module
    from pkgutil import iter_modules

    import tracewell.plans as plans

    for m in iter_modules(plans.__path__):
        if m.name.startswith("q_"):
            import_module(f"tracewell.plans.{m.name}")
