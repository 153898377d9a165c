"""Live-tail view.

The buffer is "the last N arrivals": a distributed top-k on the arrival
sequence (``TakeOrderedAndProject``: each task keeps N rows, one final merge
of N x tasks rows), never a sort of the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logpond import schema as S
from logpond.functions.severity import severity_normalise


def live_filter_condition(services=(), severities=(), term: str = "") -> Column:
    """Exact service in list, normalised severity in list, body
    contains the trimmed term (case-insensitive, no wildcards). Empty
    arguments do not filter."""
    cond = F.lit(True)
    if services:
        cond = cond & F.col("service_name").isin(list(services))
    if severities:
        cond = cond & severity_normalise("severity_text").isin(list(severities))
    t = (term or "").strip().lower()
    if t:
        cond = cond & F.lower(F.col("body")).contains(F.lit(t))
    return cond


def live_tail_filter(logs: DataFrame, services=(), severities=(), term: str = "") -> DataFrame:
    return logs.filter(live_filter_condition(services, severities, term))


def live_buffer(logs: DataFrame, arrival_col: str = "arrival_seq", size: int = S.LIVE_BUFFER_SIZE,
                since=None, ts_col: str = "ts") -> DataFrame:
    """The newest ``size`` arrivals. ``since`` (a time) restricts the scan to
    recent rows first; on a date-partitioned logs table the filter prunes
    whole days, so a dashboard view never scans the full history."""
    if since is not None:
        from logpond.operators.dashboards import as_of_col
        cond = F.col(ts_col) >= as_of_col(since)
        if "log_date" in logs.columns:
            cond = cond & (F.col("log_date") >= F.to_date(as_of_col(since)))
        logs = logs.filter(cond)
    return logs.orderBy(F.col(arrival_col).desc()).limit(size)


def live_tail_view(logs: DataFrame, arrival_col: str = "arrival_seq", services=(), severities=(),
                   term: str = "", size: int = S.LIVE_BUFFER_SIZE, rows: int = S.LIVE_VIEW_ROWS,
                   since=None) -> DataFrame:
    """Last ``size`` arrivals, newest timestamp first (ties: newest
    arrival first), then the filters, then the first ``rows``."""
    buf = live_buffer(logs, arrival_col, size, since)
    return (buf.filter(live_filter_condition(services, severities, term))
            .orderBy(F.col("ts").desc(), F.col(arrival_col).desc()).limit(rows))
