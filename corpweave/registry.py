"""Registry of named queries: each takes (spark, sf_dir) and returns one table, some with an SQL oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that register queries when they are imported.
MODULES: list[str] = [
    "corpweave.plans.texts",
    "corpweave.plans.relational",
    "corpweave.plans.gaps",
    "corpweave.plans.distances",
    "corpweave.plans.statistics",
    "corpweave.plans.sources",
    "corpweave.plans.models",
]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name`` with its DuckDB SQL, if it has one."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Query]:
    load()
    return _queries


def oracle_sql() -> dict[str, str]:
    load()
    return _oracles
