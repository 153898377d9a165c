"""Per-second / per-minute rollups and the service registry.

All of these are hash aggregations with map-side partial aggregation, so a
hot service never lands whole in one task: each task pre-aggregates its rows
into at most (seconds x services) entries before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpond import schema as S


def is_error(col: str = "severity_number"):
    return F.col(col) >= S.ERROR_SEVERITY_MIN


def metrics_1s(logs: DataFrame) -> DataFrame:
    """A1: count and error count by (second, service)."""
    return (logs
            .groupBy(F.date_trunc("second", "ts").alias("ts"), "service_name")
            .agg(F.count(F.lit(1)).alias("logs_count"),
                 F.count_if(is_error()).alias("errors_count")))


def metrics_1m(m1s: DataFrame) -> DataFrame:
    """A2: per-minute sums of the per-second rollup rows."""
    return rollup_sum(m1s, "minute")


def rollup_sum(metrics: DataFrame, unit: str) -> DataFrame:
    return (metrics
            .groupBy(F.date_trunc(unit, "ts").alias("ts"), "service_name")
            .agg(F.sum("logs_count").cast("bigint").alias("logs_count"),
                 F.sum("errors_count").cast("bigint").alias("errors_count")))


def metrics_compact(deltas: DataFrame) -> DataFrame:
    """A3: collapse delta rows with the same (ts, service) by summing.

    Readers of the summing tables always go through this (or an equivalent
    ``groupBy().sum``), never the raw deltas.
    """
    return (deltas.groupBy("ts", "service_name")
            .agg(F.sum("logs_count").cast("bigint").alias("logs_count"),
                 F.sum("errors_count").cast("bigint").alias("errors_count")))


def registry_delta(logs: DataFrame, block_col: str | None = None) -> DataFrame:
    """A4: first / last second seen per service (per insert block when a
    block column is given)."""
    keys = ["service_name"] + ([block_col] if block_col else [])
    sec = F.date_trunc("second", "ts")
    out = logs.groupBy(*keys).agg(F.min(sec).alias("first_seen"), F.max(sec).alias("last_seen"))
    return out


def registry_latest(deltas: DataFrame, first_seen: str = "global") -> DataFrame:
    """A5: one row per service. ``last_seen`` is the greatest value;
    ``first_seen`` is the global minimum (``"global"``) or, to reproduce a
    latest-wins table exactly, the value stored with that newest row
    (``"latest_block"``)."""
    if first_seen == "global":
        return deltas.groupBy("service_name").agg(
            F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    if first_seen == "latest_block":
        return (deltas.groupBy("service_name")
                .agg(F.max_by(F.struct("first_seen", "last_seen"), "last_seen").alias("r"))
                .select("service_name", "r.first_seen", "r.last_seen"))
    raise ValueError(f"first_seen must be 'global' or 'latest_block', got {first_seen!r}")


def distinct_services(registry: DataFrame) -> DataFrame:
    """Service names from the collapsed registry."""
    return registry.select("service_name").distinct()
