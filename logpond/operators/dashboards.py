"""Dashboard panels over the rollup tables.

Every "now" is an explicit ``as_of`` (string, datetime or Column; ``None``
means ``current_timestamp()``), so results are reproducible. Look-back
windows are bounded above by ``as_of`` as well, which is what "now" means
for a live table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logpond import schema as S


def as_of_col(as_of=None) -> Column:
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, (dt.datetime, dt.date)):
        return F.lit(as_of.isoformat(sep=" ") if isinstance(as_of, dt.datetime) else as_of.isoformat()).cast("timestamp")
    return F.lit(str(as_of)).cast("timestamp")


def seconds(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))


def window_bounds(as_of, span_seconds: int) -> tuple[Column, Column]:
    """[end - span, end) with end = as_of cut to the second."""
    end = F.date_trunc("second", as_of_col(as_of))
    return end - seconds(span_seconds), end


def _window_counts(m1s: DataFrame, as_of, span_seconds: int) -> DataFrame:
    start, end = window_bounds(as_of, span_seconds)
    return (m1s.filter((F.col("ts") >= start) & (F.col("ts") < end) & (F.col("service_name") != ""))
            .groupBy("service_name", "ts")
            .agg(F.sum("logs_count").cast("bigint").alias("n")))


def _per_service_maps(m1s: DataFrame, as_of, span_seconds: int) -> DataFrame:
    # At most span_seconds entries per service: the group is bounded by the
    # window length, not by the data volume.
    return (_window_counts(m1s, as_of, span_seconds)
            .groupBy("service_name")
            .agg(F.map_from_entries(F.collect_list(F.struct("ts", "n"))).alias("m")))


def _spine(as_of, span_seconds: int) -> Column:
    start, end = window_bounds(as_of, span_seconds)
    return F.sequence(start, end - seconds(1), F.expr("INTERVAL 1 SECOND"))


def ingestion_series(m1s: DataFrame, as_of=None,
                     span_seconds: int = S.INGESTION_WINDOW_SECONDS) -> DataFrame:
    """A7 + J2: per-service log counts for each second of [end-60s, end),
    missing seconds filled with 0. Services with no row in the window are
    absent; an empty window gives no rows."""
    per = _per_service_maps(m1s, as_of, span_seconds)
    return (per.select("service_name", F.explode(_spine(as_of, span_seconds)).alias("ts"), "m")
            .select("service_name", "ts",
                    F.coalesce(F.try_element_at("m", F.col("ts")), F.lit(0)).cast("bigint").alias("logs_count")))


def ingestion_series_arrays(m1s: DataFrame, as_of=None,
                            span_seconds: int = S.INGESTION_WINDOW_SECONDS) -> DataFrame:
    """A7 chart shape: one row per service with the epoch-ms timestamps and
    the matching counts, both ordered by time."""
    per = _per_service_maps(m1s, as_of, span_seconds)
    spine = _spine(as_of, span_seconds)
    return per.select(
        "service_name",
        F.transform(spine, lambda t: F.unix_millis(t)).alias("timestamps"),
        F.transform(spine, lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0)).cast("bigint")).alias("counts"),
    )


def error_rate(m1s: DataFrame, as_of=None,
               minutes: int = S.ERROR_RATE_WINDOW_MINUTES) -> DataFrame:
    """Error percentage over the last ``minutes``; no logs gives 0."""
    now = as_of_col(as_of)
    recent = m1s.filter((F.col("ts") >= now - seconds(60 * minutes)) & (F.col("ts") <= now))
    rate = F.sum("errors_count") / F.nullif(F.sum("logs_count"), F.lit(0))
    return recent.agg((F.coalesce(rate, F.lit(0.0)) * 100).alias("current_rate"))


def top_service_errors(m1m: DataFrame, as_of=None, hours: int = S.TOP_ERRORS_WINDOW_HOURS,
                       limit: int = S.TOP_ERRORS_LIMIT) -> DataFrame:
    """Services with the highest error rate over the last hour of
    the per-minute rollup. Ties are broken by service name. The rate is
    rounded half-to-even, as the original store rounds floats."""
    now = as_of_col(as_of)
    recent = m1m.filter((F.col("ts") >= now - seconds(3600 * hours)) & (F.col("ts") <= now))
    per = recent.groupBy("service_name").agg(
        F.sum("errors_count").cast("bigint").alias("total_errors"),
        F.bround(F.sum("errors_count") / F.sum("logs_count") * 100, 2).alias("error_rate"))
    return per.orderBy(F.col("error_rate").desc(), F.col("service_name").asc()).limit(limit)


def service_error_rates(m1m: DataFrame, as_of=None, hours: int = S.TOP_ERRORS_WINDOW_HOURS) -> DataFrame:
    """A9 without the limit (input of the threshold band lookup)."""
    now = as_of_col(as_of)
    recent = m1m.filter((F.col("ts") >= now - seconds(3600 * hours)) & (F.col("ts") <= now))
    return recent.groupBy("service_name").agg(
        F.sum("errors_count").cast("bigint").alias("total_errors"),
        F.bround(F.sum("errors_count") / F.sum("logs_count") * 100, 2).alias("error_rate"))


def log_rate_stats(m1s: DataFrame, as_of=None,
                   current_seconds: int = S.LOG_RATE_CURRENT_SECONDS,
                   baseline_seconds: int = S.LOG_RATE_BASELINE_SECONDS) -> DataFrame:
    """Logs per second over the last 5 s and the last 60 s, and
    their ratio, in one pass with conditional sums (no join of two scalar
    sub-results). Both windows are lower-bounded at ``now - n`` with ``now``
    cut to the second, upper-bounded by ``as_of``."""
    at = as_of_col(as_of)
    now = F.date_trunc("second", at)
    recent = m1s.filter((F.col("ts") >= now - seconds(baseline_seconds)) & (F.col("ts") <= at))
    cur_sum = F.coalesce(F.sum(F.when(F.col("ts") >= now - seconds(current_seconds), F.col("logs_count"))), F.lit(0))
    base_sum = F.coalesce(F.sum("logs_count"), F.lit(0))
    stats = recent.agg((cur_sum / current_seconds).alias("current_rate"),
                       (base_sum / baseline_seconds).alias("avg_rate"))
    return stats.select(
        "current_rate", "avg_rate",
        F.coalesce(F.col("current_rate") / F.nullif(F.col("avg_rate"), F.lit(0.0)), F.lit(0.0)).alias("ratio"))
