"""Registered queries for UI data rules, thresholds, retry / DLQ, queue
samples and live tail."""

from __future__ import annotations

from pyspark.sql import functions as F

from logpond import schema as S
from logpond.functions import cards as C
from logpond.functions.severity import severity_band, severity_normalise
from logpond.functions.text import body_hits, short_number
from logpond.operators import dashboards as D
from logpond.operators import livetail as L
from logpond.operators import queue as QU
from logpond.operators import retry as RT
from logpond.operators.thresholds import error_rate_band
from logpond.plans.oracle import logs_cte, metrics_1m_cte, metrics_1s_cte, ts_lit, with_ctes
from logpond.plans.q_dashboards import AS_OF_RATE, AS_OF_TOP, recent
from logpond.plans.registry import ntz, query
from logpond.session import scratch_path
from logpond.sources.events_adapter import dense_micros, read_logs
from logpond.sources.tables import read_table

BASE = with_ctes(logs_cte())
METRICS = with_ctes(logs_cte(), metrics_1s_cte(), metrics_1m_cte())


# -- severity and text rules ---------------------------------------------------
def _sev_variant():
    m = F.col("event_id") % 6
    t = F.col("severity_text")
    return (F.when(m == 0, t).when(m == 1, F.concat(t, F.lit("2"))).when(m == 2, F.concat(F.lower(t), F.lit("13")))
            .when(m == 3, F.lit("")).when(m == 4, F.lit("Warn3")).otherwise(F.lit("notice")))


_NORM_SQL = """CASE {x} WHEN 'trace' THEN 'trace' WHEN 'debug' THEN 'debug' WHEN 'info' THEN 'info'
  WHEN 'warning' THEN 'warn' WHEN 'warn' THEN 'warn' WHEN 'error' THEN 'error' WHEN 'fatal' THEN 'fatal'
  ELSE 'info' END"""


@query("severity_normalise", BASE + """
, v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN severity_text WHEN 1 THEN severity_text || '2'
          WHEN 2 THEN lower(severity_text) || '13' WHEN 3 THEN '' WHEN 4 THEN 'Warn3' ELSE 'notice' END AS t
        FROM logs)
SELECT event_id, t AS severity_text,
  CASE WHEN t IS NULL OR t = '' THEN 'info' ELSE """ + _NORM_SQL.format(x="lower(regexp_replace(t, '\\d+$', ''))") + """ END AS normalised,
  CASE WHEN t IS NULL OR t = '' THEN 'info' ELSE """ + _NORM_SQL.format(x="lower(t)") + """ END AS normalised_table
FROM v""")
def q_severity_normalise(spark, sf_dir):
    v = read_logs(spark, sf_dir).select("event_id", _sev_variant().alias("severity_text"))
    return v.select("event_id", "severity_text", severity_normalise("severity_text").alias("normalised"),
                    severity_normalise("severity_text", strip_digits=False).alias("normalised_table"))


@query("severity_band", """
SELECT event_id, CAST(event_id % 26 AS INTEGER) AS severity_number,
  CASE WHEN event_id % 26 BETWEEN 5 AND 8 THEN 'DEBUG' WHEN event_id % 26 BETWEEN 9 AND 12 THEN 'INFO'
       WHEN event_id % 26 BETWEEN 13 AND 16 THEN 'WARNING' WHEN event_id % 26 BETWEEN 17 AND 20 THEN 'ERROR'
       WHEN event_id % 26 BETWEEN 21 AND 24 THEN 'FATAL' END AS band
FROM events""")
def q_severity_band(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 26).cast("int").alias("severity_number"))
    return ev.select("event_id", "severity_number", severity_band("severity_number").alias("band"))


HIT_TERM = " ÉAU "


@query("body_hits", """
SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)éau')) AS INTEGER) AS hits,
       md5(regexp_replace(text, '(?i)(éau)', chr(1) || '\\1' || chr(1), 'g')) AS parts_md5 FROM documents""")
def q_body_hits(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    parts, hits = body_hits(F.col("text"), HIT_TERM)
    return docs.select("doc_id", hits.cast("int").alias("hits"),
                       F.md5(F.encode(F.array_join(parts, "\x01"), "UTF-8")).alias("parts_md5"))


def _significant_sql(v: str) -> str:
    """Three significant digits of v >= 1 by the rule: the exponent e, the
    number as digits x 10^(e - 2), and from e = 3 on an exponent."""
    e = f"CAST(floor(log10({v}) + 1e-12) AS INTEGER)"
    n = f"CAST(floor(CASE {e} WHEN 0 THEN {v} * 100 WHEN 1 THEN {v} * 10 ELSE {v} / power(10, {e} - 2) END + 0.5) AS BIGINT)"
    e, n = f"({e} + CASE WHEN {n} >= 1000 THEN 1 ELSE 0 END)", f"CAST(CASE WHEN {n} >= 1000 THEN 100 ELSE {n} END AS VARCHAR)"
    return (f"CASE {e} WHEN 0 THEN substr({n}, 1, 1) || '.' || substr({n}, 2) "
            f"WHEN 1 THEN CASE WHEN {v} < 10 THEN '10.0' ELSE substr({n}, 1, 2) || '.' || substr({n}, 3) END "
            f"WHEN 2 THEN {n} ELSE substr({n}, 1, 1) || '.' || substr({n}, 2) || 'e+' || CAST({e} AS VARCHAR) END")


def _short_sql(x: str) -> str:
    return (f"CASE WHEN {x} >= 1e9 THEN {_significant_sql(f'({x} / 1e9)')} || 'B' "
            f"WHEN {x} >= 1e6 THEN {_significant_sql(f'({x} / 1e6)')} || 'M' "
            f"WHEN {x} >= 1e3 THEN {_significant_sql(f'({x} / 1e3)')} || 'k' "
            f"ELSE regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '') END")


@query("short_number", """
WITH n AS (SELECT event_id, value * power(10, event_id % 12) AS x FROM events)
SELECT event_id, x, """ + _short_sql("x") + """ AS text FROM n""")
def q_short_number(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    n = ev.select("event_id", (F.col("value") * F.pow(F.lit(10.0), (F.col("event_id") % 12).cast("double"))).alias("x"))
    return n.select("event_id", "x", short_number("x").alias("text"))


# -- cards --------------------------------------------------------------------
_RATE_SQL = METRICS + f"""
, s AS (SELECT coalesce(sum(logs_count) FILTER (WHERE ts >= date_trunc('second', {ts_lit(AS_OF_RATE)}) - INTERVAL 5 SECOND), 0) / 5 AS current_rate,
               coalesce(sum(logs_count), 0) / 60 AS avg_rate
        FROM m1s WHERE ts >= date_trunc('second', {ts_lit(AS_OF_RATE)}) - INTERVAL 60 SECOND AND ts <= {ts_lit(AS_OF_RATE)})
, r AS (SELECT current_rate, avg_rate, coalesce(current_rate / nullif(avg_rate, 0), 0) AS ratio,
               (coalesce(current_rate / nullif(avg_rate, 0), 0) - 1) * 100 AS pct FROM s)
"""


@query("log_rate_card", _RATE_SQL + f"""
SELECT {_short_sql('current_rate')} AS value,
  CASE WHEN avg_rate = 0 THEN 'No logs received in the past minute.'
       WHEN pct > 0 THEN '↑ ' || printf('%.0f', floor(abs(pct) + 0.5)) || '% vs 60s avg'
       WHEN pct < 0 THEN '↓ ' || printf('%.0f', floor(abs(pct) + 0.5)) || '% vs 60s avg'
       ELSE '~ 0% vs 60s avg' END AS delta,
  CASE WHEN avg_rate = 0 THEN 'silent' WHEN pct > 0 THEN 'up' WHEN pct < 0 THEN 'down' ELSE 'flat' END AS level
FROM r""")
def q_log_rate_card(spark, sf_dir):
    return C.log_rate_card(D.log_rate_stats(recent(spark, sf_dir, "1s", AS_OF_RATE, S.LOG_RATE_BASELINE_SECONDS), AS_OF_RATE))


@query("error_level", METRICS + f"""
, e AS (SELECT coalesce(sum(errors_count) / nullif(sum(logs_count), 0), 0) * 100 AS r
        FROM m1s WHERE ts >= {ts_lit(AS_OF_RATE)} - INTERVAL 5 MINUTE AND ts <= {ts_lit(AS_OF_RATE)})
SELECT printf('%.2f', floor(r * 100 + 0.5) / 100) AS value,
  CASE WHEN r < 1 THEN '● Normal' WHEN r < 5 THEN '● Elevated' ELSE '● Critical' END AS delta,
  CASE WHEN r < 1 THEN 'normal' WHEN r < 5 THEN 'elevated' ELSE 'critical' END AS level
FROM e""")
def q_error_level(spark, sf_dir):
    return C.error_level(D.error_rate(recent(spark, sf_dir, "1s", AS_OF_RATE, 60 * S.ERROR_RATE_WINDOW_MINUTES), AS_OF_RATE))


@query("error_rate_band", METRICS + f"""
, r AS (SELECT service_name, CAST(sum(errors_count) AS BIGINT) AS total_errors,
               round_even(sum(errors_count) / sum(logs_count) * 100, 2) AS error_rate
        FROM m1m WHERE ts >= {ts_lit(AS_OF_TOP)} - INTERVAL 1 HOUR AND ts <= {ts_lit(AS_OF_TOP)}
        GROUP BY service_name)
SELECT service_name, total_errors, error_rate,
  CASE WHEN error_rate >= 80 THEN '#ef5350' WHEN error_rate >= 60 THEN '#ffa726'
       WHEN error_rate >= 40 THEN '#fbc02d' WHEN error_rate >= 20 THEN '#42a5f5'
       WHEN error_rate >= 0 THEN '#607d8b' ELSE '#607d8b' END AS band_colour,
  CASE WHEN error_rate >= 80 THEN 'Critical' WHEN error_rate >= 60 THEN 'High'
       WHEN error_rate >= 40 THEN 'Medium' WHEN error_rate >= 20 THEN 'Low'
       WHEN error_rate >= 0 THEN 'Minimal' END AS band_label
FROM r""")
def q_error_rate_band(spark, sf_dir):
    rates = D.service_error_rates(recent(spark, sf_dir, "1m", AS_OF_TOP, 3600 * S.TOP_ERRORS_WINDOW_HOURS), AS_OF_TOP)
    return error_rate_band(rates, S.DEFAULT_THRESHOLDS)


# -- retry / DLQ --------------------------------------------------------------
def _failures(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    m = F.col("event_id") % 13
    return ev.select(F.col("event_id").alias("msg_id"),
                     F.when(m == 12, F.lit(None)).otherwise(m).cast("int").alias("num_delivered"),
                     F.timestamp_micros(dense_micros("event_id")).alias("failed_at"),
                     F.encode("props", "UTF-8").alias("payload"),
                     F.when(F.col("event_id") % 2 == 0, "application/json").otherwise("application/x-protobuf").alias("content_type"),
                     F.get(F.array(F.lit(""), F.lit("gzip"), F.lit("zstd")), F.col("event_id") % 3).alias("content_encoding"))


_FAIL_SQL = """
WITH f AS (SELECT event_id AS msg_id, CASE WHEN event_id % 13 = 12 THEN NULL ELSE event_id % 13 END AS n, props,
                  CASE WHEN event_id % 2 = 0 THEN 'application/json' ELSE 'application/x-protobuf' END AS content_type,
                  ['', 'gzip', 'zstd'][1 + event_id % 3] AS content_encoding FROM events)
"""


@query("retry_route", _FAIL_SQL + """
SELECT msg_id, CASE WHEN n >= 10 THEN 'dlq' ELSE 'retry' END AS action,
  CAST(CASE WHEN n IS NULL THEN 30 WHEN n >= 10 THEN NULL WHEN n >= 5 THEN 3600
       ELSE [5, 30, 60, 300, 3600][greatest(n, 1)] END AS INTEGER) AS delay_seconds
FROM f""")
def q_retry_route(spark, sf_dir):
    r = RT.retry_route(_failures(spark, sf_dir))
    return r.select("msg_id", "action", "delay_seconds")


def _dlq_table(spark, sf_dir):
    path = scratch_path(spark, "dlq")
    RT.dlq_sink(RT.retry_route(_failures(spark, sf_dir)), path)
    return RT.read_dlq(spark, path)


@query("dlq_sink", _FAIL_SQL + """
SELECT msg_id, CAST(n AS INTEGER) AS num_delivered, 'max deliveries reached' AS failure_reason,
       props AS payload_text, content_type, content_encoding FROM f WHERE n >= 10""")
def q_dlq_sink(spark, sf_dir):
    return _dlq_table(spark, sf_dir).select("msg_id", "num_delivered", "failure_reason",
                                          F.decode("payload", "UTF-8").alias("payload_text"), "content_type", "content_encoding")


@query("dlq_depth", _FAIL_SQL + "SELECT count(*) AS num_messages FROM f WHERE n >= 10")
def q_dlq_depth(spark, sf_dir):
    return RT.dlq_depth(_dlq_table(spark, sf_dir))


@query("dlq_state", _FAIL_SQL + """
, d AS (SELECT count(*) AS n FROM f WHERE n >= 10)
SELECT n AS value, CASE WHEN n = 0 THEN '● Empty' ELSE '● Messages need recovery' END AS delta,
       CASE WHEN n = 0 THEN 'empty' ELSE 'recovery' END AS level FROM d""")
def q_dlq_state(spark, sf_dir):
    return C.dlq_state(RT.dlq_depth(_dlq_table(spark, sf_dir)))


# -- queue samples ------------------------------------------------------------
SAMPLE_MICROS = 15_000_000


def _samples(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    micros = dense_micros("event_id")
    s = ev.select(F.timestamp_micros(micros - micros % SAMPLE_MICROS).alias("ts"),
                  F.concat(F.lit("worker-"), (F.col("user_id") % 2).cast("string")).alias("consumer_name"),
                  "event_type", "event_id")
    return s.groupBy("ts", "consumer_name").agg(
        F.lit("LOGS").alias("stream_name"),
        F.count_if(F.col("event_type") == "error").alias("num_ack_pending"),
        F.count_if(F.col("event_id") % 10 == 0).alias("num_redelivered"),
        F.count(F.lit(1)).alias("num_pending"))


def _samples_sql() -> str:
    from logpond.sources import events_adapter as A
    micros = (f"({A.DENSE_EPOCH_MICROS} + event_id * {A.DENSE_STEP_MICROS} - CASE WHEN "
              f"(event_id // {A.DENSE_BURST_BLOCK}) % 2 = 1 THEN (event_id % {A.DENSE_BURST_BLOCK}) * "
              f"{A.DENSE_BURST_SHIFT_MICROS} ELSE 0 END)")
    return f"""
WITH e AS (SELECT *, {micros} AS micros FROM events),
s AS (SELECT make_timestamp(micros - micros % {SAMPLE_MICROS}) AS ts,
             'worker-' || CAST(user_id % 2 AS VARCHAR) AS consumer_name, 'LOGS' AS stream_name,
             count(*) FILTER (WHERE event_type = 'error') AS num_ack_pending,
             count(*) FILTER (WHERE event_id % 10 = 0) AS num_redelivered, count(*) AS num_pending
      FROM e GROUP BY 1, 2)
"""


@query("queue_samples_append", _samples_sql() + """
SELECT ts, consumer_name, stream_name, num_ack_pending, num_redelivered, num_pending FROM s""")
def q_queue_samples_append(spark, sf_dir):
    path = scratch_path(spark, "queue_samples")
    QU.append_samples(_samples(spark, sf_dir), path)
    t = QU.read_samples(spark, path)
    return t.select(ntz("ts"), "consumer_name", "stream_name", "num_ack_pending", "num_redelivered", "num_pending")


QUEUE_AS_OF = "2024-01-01 00:15:00"


@query("queue_depth_series", _samples_sql() + f"""
SELECT epoch_ms(ts) AS ts_ms, consumer_name, num_pending, num_ack_pending, num_redelivered FROM s
WHERE ts >= {ts_lit(QUEUE_AS_OF)} - INTERVAL 15 MINUTE AND ts <= {ts_lit(QUEUE_AS_OF)}""")
def q_queue_depth_series(spark, sf_dir):
    return QU.queue_depth_series(_samples(spark, sf_dir), QUEUE_AS_OF)


@query("queue_stability", _samples_sql() + """
, t AS (SELECT *, epoch_us(ts) / 1e6 AS x FROM s)
, b AS (SELECT consumer_name, (min(x) + max(x)) / 2 AS mid FROM t GROUP BY 1)
, sl AS (SELECT t.consumer_name, regr_slope(CAST(num_pending AS DOUBLE), x) AS slope
         FROM t JOIN b USING (consumer_name) WHERE x >= mid GROUP BY 1)
, p AS (SELECT consumer_name, max(num_pending) AS peak_pending, arg_max(num_pending, ts) AS last_pending,
               count(*) AS samples FROM s GROUP BY 1)
SELECT p.consumer_name, peak_pending, last_pending, samples, round(slope, 4) AS slope,
       coalesce(slope, 0) <= 0 AS stable
FROM p LEFT JOIN sl USING (consumer_name)""")
def q_queue_stability(spark, sf_dir):
    out = QU.queue_stability(_samples(spark, sf_dir))
    return out.select("consumer_name", "peak_pending", "last_pending", "samples",
                      F.round("slope", 4).alias("slope"), "stable")


# -- live tail ----------------------------------------------------------------
LIVE = dict(services=("svc-1", "svc-2", "svc-4"), severities=("warn", "error", "debug"), term="  BY USER 1")


@query("live_tail_filter", BASE + """
SELECT event_id, ts, service_name FROM logs
WHERE service_name IN ('svc-1', 'svc-2', 'svc-4') AND severity_text IN ('WARNING', 'ERROR', 'DEBUG')
  AND contains(lower(body), 'by user 1')""")
def q_live_tail_filter(spark, sf_dir):
    logs = read_logs(spark, sf_dir)
    return L.live_tail_filter(logs, **LIVE).select("event_id", ntz("ts"), "service_name")


@query("live_tail_view", BASE + """
, buf AS (SELECT * FROM logs ORDER BY event_id DESC LIMIT 300)
SELECT event_id, ts, service_name FROM buf
WHERE service_name IN ('svc-1', 'svc-2', 'svc-4') AND severity_text IN ('WARNING', 'ERROR', 'DEBUG')
ORDER BY ts DESC, event_id DESC LIMIT 15""")
def q_live_tail_view(spark, sf_dir):
    logs = read_logs(spark, sf_dir).withColumn("arrival_seq", F.col("event_id"))
    v = L.live_tail_view(logs, "arrival_seq", services=LIVE["services"], severities=LIVE["severities"])
    return v.select("event_id", ntz("ts"), "service_name")
