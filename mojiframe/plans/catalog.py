"""Registry of named queries: a Spark builder plus, where the operator is
expressible in SQL, the equivalent DuckDB/ANSI SQL used as the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, Callable[[], str]] = {}


def register(name: str, sql: Callable[[], str] | str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query name {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql if callable(sql) else (lambda s=sql: s)
        return fn

    return deco


def _load_all() -> None:
    # importing the modules fills the registry
    from mojiframe.plans import (  # noqa: F401
        q_text, q_splits, q_eval, q_reports, q_features, q_fusion, q_sources,
    )


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: f() for k, f in _SQL.items()}
