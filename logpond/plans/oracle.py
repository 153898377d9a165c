"""DuckDB SQL building blocks for the correctness oracle.

``logs_cte`` is the SQL twin of ``sources.events_adapter.logs_from_events``;
``metrics_cte`` etc. are the twins of the rollup operators. Oracle queries
are assembled from these so that each registered query has an independent,
plain-SQL statement of the expected rows.
"""

from __future__ import annotations

from logpond.sources import events_adapter as A


def ts_lit(ts: str) -> str:
    return f"TIMESTAMP '{ts}'"


def logs_cte(name: str = "logs", clock: str = "dense") -> str:
    if clock == "dense":
        micros = (f"({A.DENSE_EPOCH_MICROS} + event_id * {A.DENSE_STEP_MICROS} - CASE WHEN "
                  f"(event_id // {A.DENSE_BURST_BLOCK}) % 2 = 1 THEN (event_id % {A.DENSE_BURST_BLOCK}) * "
                  f"{A.DENSE_BURST_SHIFT_MICROS} ELSE 0 END)")
        ts = f"make_timestamp({micros})"
        nanos = f"{micros} * 1000"
    else:
        ts = "CAST(ts AS TIMESTAMP)"
        nanos = "epoch_us(CAST(ts AS TIMESTAMP)) * 1000"
    return f"""{name} AS (
  SELECT
    event_id,
    {ts} AS ts,
    {nanos} AS ts_nanos,
    {ts} + INTERVAL {A.OBSERVED_DELAY_MICROS} MICROSECOND AS observed_ts,
    {nanos} + {A.OBSERVED_DELAY_MICROS * 1000} + event_id % 1000 AS observed_ts_nanos,
    date_trunc('second', {ts}) AS inserted_at,
    md5(CAST(event_id AS VARCHAR)) AS trace_id,
    substr(md5('s' || CAST(event_id AS VARCHAR)), 1, 16) AS span_id,
    CASE WHEN event_type = 'error' AND event_id % 8 >= 4 THEN 'FATAL'
         WHEN event_type = 'error' THEN 'ERROR'
         WHEN event_type = 'purchase' THEN 'WARNING'
         WHEN event_type = 'view' THEN 'DEBUG'
         ELSE 'INFO' END AS severity_text,
    CAST(CASE WHEN event_type = 'error' THEN 17 + event_id % 8
              WHEN event_type = 'purchase' THEN 13 + event_id % 4
              WHEN event_type = 'view' THEN 5 + event_id % 4
              ELSE 9 + event_id % 4 END AS INTEGER) AS severity_number,
    'svc-' || CAST(user_id % {A.N_SERVICES} AS VARCHAR) AS service_name,
    event_type || ' by user ' || CAST(user_id AS VARCHAR) || ' ' || props AS body,
    'string' AS body_type,
    '{A.SCOPE_NAME}' AS scope_name,
    '{A.SCOPE_VERSION}' AS scope_version,
    ['event.type', 'k'] AS log_attr_keys,
    [event_type, json_extract_string(props, '$.k')] AS log_attr_values,
    ['service.name'] AS res_attr_keys,
    ['svc-' || CAST(user_id % {A.N_SERVICES} AS VARCHAR)] AS res_attr_values,
    CAST({ts} AS DATE) AS log_date
  FROM events
)"""


def metrics_1s_cte(name: str = "m1s", src: str = "logs") -> str:
    return f"""{name} AS (
  SELECT date_trunc('second', ts) AS ts, service_name,
         CAST(count(*) AS BIGINT) AS logs_count,
         CAST(count(*) FILTER (WHERE severity_number >= 17) AS BIGINT) AS errors_count
  FROM {src} GROUP BY 1, 2
)"""


def metrics_1m_cte(name: str = "m1m", src: str = "m1s") -> str:
    return f"""{name} AS (
  SELECT date_trunc('minute', ts) AS ts, service_name,
         CAST(sum(logs_count) AS BIGINT) AS logs_count,
         CAST(sum(errors_count) AS BIGINT) AS errors_count
  FROM {src} GROUP BY 1, 2
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
