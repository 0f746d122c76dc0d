"""Registry of runnable queries and the SQL that states the same result.

Each check reads the tables of one folder and returns a DataFrame. Where plain
SQL can state the result, the check carries it as its ``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Check = Callable[[SparkSession, str], DataFrame]

_FAMILIES = ("gold", "expansion", "responses", "matching", "execution", "schema_text", "workflow", "reports", "mining", "storage", "live")
_QUERIES: dict[str, Check] = {}
_ORACLES: dict[str, str] = {}


def check(name: str, oracle: str | None = None) -> Callable[[Check], Check]:
    def register(fn: Check) -> Check:
        if name in _QUERIES:
            raise ValueError(f"check {name} is registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return register


def _load() -> None:
    for family in _FAMILIES:
        import_module(f"assayer.checks.{family}")


def queries() -> dict[str, Check]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
