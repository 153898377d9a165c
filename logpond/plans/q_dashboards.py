"""Registered dashboard queries: rollups, registry and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from logpond import schema as S
from logpond.operators import dashboards as D
from logpond.operators import rollups as R
from logpond.plans.oracle import logs_cte, metrics_1m_cte, metrics_1s_cte, ts_lit, with_ctes
from logpond.plans.registry import ntz, query
from logpond.session import scratch_path
from logpond.sources.events_adapter import read_logs
from logpond.streaming import commits as C
from logpond.streaming import ingest as I

# Fixed query parameters (inside a burst of the dense clock at every scale)
AS_OF_RATE = "2024-01-01 00:01:15"
AS_OF_TOP = "2024-01-01 00:10:00"
INSERT_BLOCK = 100          # rows per simulated insert block

BASE = with_ctes(logs_cte(), metrics_1s_cte(), metrics_1m_cte())


def _m1s(spark, sf_dir):
    return R.metrics_1s(read_logs(spark, sf_dir))


_ROLLUPS: dict = {}


def rollup_root(spark, sf_dir) -> str:
    """The rollup tables of the logs as the ingest writes them, by hour: made
    once per session and input folder, read by every panel."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ROLLUPS:
        root = scratch_path(spark, "rollups")
        attempt = C.new_attempt(0)
        I.write_rollups(read_logs(spark, sf_dir), attempt, I.IngestPaths(root))
        C.commit(spark, root, 0, attempt)
        _ROLLUPS[key] = root
    return _ROLLUPS[key]


def recent(spark, sf_dir, grain, as_of, seconds):
    """What a panel with that look-back reads: the hours it touches."""
    return I.read_recent(spark, rollup_root(spark, sf_dir), grain, as_of, seconds)


@query("metrics_1s", BASE + "SELECT ts, service_name, logs_count, errors_count FROM m1s")
def q_metrics_1s(spark, sf_dir):
    m = _m1s(spark, sf_dir)
    return m.select(ntz("ts"), "service_name", "logs_count", "errors_count")


@query("metrics_1m", BASE + "SELECT ts, service_name, logs_count, errors_count FROM m1m")
def q_metrics_1m(spark, sf_dir):
    m = R.metrics_1m(_m1s(spark, sf_dir))
    return m.select(ntz("ts"), "service_name", "logs_count", "errors_count")


@query("metrics_compact", BASE + "SELECT ts, service_name, logs_count, errors_count FROM m1s")
def q_metrics_compact(spark, sf_dir):
    # deltas as a streaming sink writes them: one rollup per insert block,
    # so the same (second, service) key appears in several delta rows
    logs = read_logs(spark, sf_dir).withColumn("block", F.expr(f"event_id div {INSERT_BLOCK}"))
    deltas = (logs.groupBy("block", F.date_trunc("second", "ts").alias("ts"), "service_name")
              .agg(F.count(F.lit(1)).alias("logs_count"), F.count_if(R.is_error()).alias("errors_count")))
    m = R.metrics_compact(deltas)
    return m.select(ntz("ts"), "service_name", "logs_count", "errors_count")


_REGISTRY_SQL = BASE + """
SELECT service_name, CAST(min(date_trunc('second', ts)) AS TIMESTAMP) AS first_seen,
       CAST(max(date_trunc('second', ts)) AS TIMESTAMP) AS last_seen
FROM logs GROUP BY service_name"""


@query("service_registry", _REGISTRY_SQL)
def q_service_registry(spark, sf_dir):
    r = R.registry_delta(read_logs(spark, sf_dir))
    return r.select("service_name", ntz("first_seen"), ntz("last_seen"))


def _registry_from_blocks(spark, sf_dir, first_seen="global"):
    logs = read_logs(spark, sf_dir).withColumn("block", F.expr(f"event_id div {INSERT_BLOCK}"))
    deltas = R.registry_delta(logs, "block")
    return R.registry_latest(deltas, first_seen)


@query("registry_latest", _REGISTRY_SQL)
def q_registry_latest(spark, sf_dir):
    r = _registry_from_blocks(spark, sf_dir)
    return r.select("service_name", ntz("first_seen"), ntz("last_seen"))


@query("distinct_services", BASE + "SELECT DISTINCT service_name FROM logs")
def q_distinct_services(spark, sf_dir):
    return R.distinct_services(_registry_from_blocks(spark, sf_dir))


@query("ingestion_series", BASE + f"""
, w AS (SELECT service_name, ts, sum(logs_count) AS n FROM m1s
        WHERE ts >= date_trunc('second', {ts_lit(AS_OF_RATE)}) - INTERVAL 60 SECOND
          AND ts < date_trunc('second', {ts_lit(AS_OF_RATE)}) AND service_name <> ''
        GROUP BY ALL),
svc AS (SELECT DISTINCT service_name FROM w),
spine AS (SELECT unnest(generate_series(date_trunc('second', {ts_lit(AS_OF_RATE)}) - INTERVAL 60 SECOND,
                                         date_trunc('second', {ts_lit(AS_OF_RATE)}) - INTERVAL 1 SECOND,
                                         INTERVAL 1 SECOND)) AS ts)
SELECT svc.service_name, spine.ts, CAST(coalesce(w.n, 0) AS BIGINT) AS logs_count
FROM svc CROSS JOIN spine LEFT JOIN w ON w.service_name = svc.service_name AND w.ts = spine.ts""")
def q_ingestion_series(spark, sf_dir):
    s = D.ingestion_series(recent(spark, sf_dir, "1s", AS_OF_RATE, S.INGESTION_WINDOW_SECONDS), AS_OF_RATE)
    return s.select("service_name", ntz("ts"), "logs_count")


@query("ingestion_series_arrays", BASE + f"""
, w AS (SELECT service_name, ts, sum(logs_count) AS n FROM m1s
        WHERE ts >= date_trunc('second', {ts_lit(AS_OF_RATE)}) - INTERVAL 60 SECOND
          AND ts < date_trunc('second', {ts_lit(AS_OF_RATE)}) AND service_name <> ''
        GROUP BY ALL),
svc AS (SELECT DISTINCT service_name FROM w),
spine AS (SELECT unnest(generate_series(0, 59)) AS idx)
SELECT svc.service_name, CAST(spine.idx AS INTEGER) AS idx,
       epoch_ms(date_trunc('second', {ts_lit(AS_OF_RATE)}) - INTERVAL 60 SECOND) + 1000 * spine.idx AS ts_ms,
       CAST(coalesce(w.n, 0) AS BIGINT) AS logs_count
FROM svc CROSS JOIN spine LEFT JOIN w ON w.service_name = svc.service_name
  AND w.ts = date_trunc('second', {ts_lit(AS_OF_RATE)}) - INTERVAL 60 SECOND + spine.idx * INTERVAL 1 SECOND""")
def q_ingestion_series_arrays(spark, sf_dir):
    a = D.ingestion_series_arrays(recent(spark, sf_dir, "1s", AS_OF_RATE, S.INGESTION_WINDOW_SECONDS), AS_OF_RATE)
    z = a.select("service_name", F.posexplode(F.arrays_zip("timestamps", "counts")).alias("idx", "p"))
    return z.select("service_name", F.col("idx").cast("int").alias("idx"),
                    F.col("p.timestamps").alias("ts_ms"), F.col("p.counts").alias("logs_count"))


@query("error_rate", BASE + f"""
SELECT coalesce(sum(errors_count) / nullif(sum(logs_count), 0), 0) * 100 AS current_rate
FROM m1s WHERE ts >= {ts_lit(AS_OF_RATE)} - INTERVAL 5 MINUTE AND ts <= {ts_lit(AS_OF_RATE)}""")
def q_error_rate(spark, sf_dir):
    return D.error_rate(recent(spark, sf_dir, "1s", AS_OF_RATE, 60 * S.ERROR_RATE_WINDOW_MINUTES), AS_OF_RATE)


_TOP_SQL = BASE + f"""
SELECT service_name, CAST(sum(errors_count) AS BIGINT) AS total_errors,
       round_even(sum(errors_count) / sum(logs_count) * 100, 2) AS error_rate
FROM m1m WHERE ts >= {ts_lit(AS_OF_TOP)} - INTERVAL 1 HOUR AND ts <= {ts_lit(AS_OF_TOP)}
GROUP BY service_name"""


@query("top_service_errors", _TOP_SQL + " ORDER BY error_rate DESC, service_name ASC LIMIT 5")
def q_top_service_errors(spark, sf_dir):
    return D.top_service_errors(recent(spark, sf_dir, "1m", AS_OF_TOP, 3600 * S.TOP_ERRORS_WINDOW_HOURS), AS_OF_TOP)


@query("log_rate_stats", BASE + f"""
, s AS (SELECT coalesce(sum(logs_count) FILTER (WHERE ts >= date_trunc('second', {ts_lit(AS_OF_RATE)}) - INTERVAL 5 SECOND), 0) / 5 AS current_rate,
               coalesce(sum(logs_count), 0) / 60 AS avg_rate
        FROM m1s WHERE ts >= date_trunc('second', {ts_lit(AS_OF_RATE)}) - INTERVAL 60 SECOND AND ts <= {ts_lit(AS_OF_RATE)})
SELECT current_rate, avg_rate, coalesce(current_rate / nullif(avg_rate, 0), 0) AS ratio FROM s""")
def q_log_rate_stats(spark, sf_dir):
    return D.log_rate_stats(recent(spark, sf_dir, "1s", AS_OF_RATE, S.LOG_RATE_BASELINE_SECONDS), AS_OF_RATE)
