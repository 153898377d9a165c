"""Query catalogue: key -> (Spark callable, DuckDB oracle SQL).

Each ``plans.q_*`` module registers its queries with ``@query``. A callable
takes ``(spark, sf_dir)`` and returns a DataFrame; column names equal those
of the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def ntz(col: str | Column, alias: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    out = c.cast("timestamp_ntz")
    name = alias or (col if isinstance(col, str) else None)
    return out.alias(name) if name else out


def load_all() -> None:
    # importing registers the queries
    from logpond.plans import (  # noqa: F401
        q_dashboards, q_search, q_decode, q_storage, q_stream, q_ops,
    )
