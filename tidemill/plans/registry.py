"""All registered queries and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

#: Modules that register queries when they are imported.
MODULES = ("corpus", "privacy", "relational", "metrics", "retrieval", "evaluation", "interchange", "live")


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers f(inputs) under a name, with DuckDB SQL over tables and views."""

    def register(f: Callable[[fixtures.Inputs], DataFrame]) -> Callable:
        _queries[name] = lambda spark, sf_dir: f(fixtures.Inputs(spark, sf_dir))
        if oracle:
            _oracles[name] = fixtures.duckdb(oracle)
        return f

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"tidemill.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)
