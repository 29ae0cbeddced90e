"""Registry: name -> (Spark query over sf_dir, optional DuckDB oracle SQL)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

_MODULES = (
    "fpengine.plans.reg_retrieval",
    "fpengine.plans.reg_relational",
    "fpengine.plans.reg_aggregate",
    "fpengine.plans.reg_scalar",
    "fpengine.plans.reg_flatten",
    "fpengine.plans.reg_graph",
    "fpengine.plans.reg_learning",
    "fpengine.plans.reg_metrics",
    "fpengine.plans.reg_io",
)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    for mod in _MODULES:
        importlib.import_module(mod)
