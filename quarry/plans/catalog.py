"""Registered queries: one Spark plan per operator, each with its DuckDB oracle.

Every query reads the given tables (whole tables, whole texts) and returns a
DataFrame; floats are rounded to 6 digits in both engines so the comparison
does not depend on summation order.  The SQL side is written independently,
as plain ANSI/DuckDB SQL over the same parquet views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.expressions import round_floats
from ..session import table

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_floats(fn(lambda t: table(spark, sf_dir, t)))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, sql)
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


def _load():
    # importing the modules registers their queries
    from . import q_explore, q_text, q_validate, q_models  # noqa: F401
