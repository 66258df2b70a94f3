"""Every query of the telemetry engine with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .plans import catalog, explorer, mechanisms  # noqa: F401  register their queries

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["usage_cube"](spark, sf_dir)
