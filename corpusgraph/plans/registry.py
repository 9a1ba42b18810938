"""Registered queries of the engine (without those of the training-data subpackage)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


class Tables:
    """The driver's tables and the views over them, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register fn(tables) under a name, with DuckDB SQL over the same tables and views."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = (lambda spark, sf_dir: fn(Tables(spark, sf_dir)), with_views(sql) if sql else None)
        return fn

    return add


def _load() -> None:
    from . import audit_queries, caller_queries, check_queries, document_queries, graph_queries, index_queries, line_queries, log_queries, module_queries, release_queries, search_queries, selection_queries, source_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return {name: fn for name, (fn, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
