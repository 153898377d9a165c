"""Registered search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from logpond.functions.values import unflatten_attrs
from logpond.operators import search as Q
from logpond.plans.oracle import logs_cte, ts_lit, with_ctes
from logpond.plans.registry import ntz, query
from logpond.sources.events_adapter import read_logs

BASE = with_ctes(logs_cte())
OUT_SQL = "SELECT event_id, ts, service_name, severity_number FROM logs"


def _rows(df):
    return df.select("event_id", ntz("ts"), "service_name", "severity_number")


def _filtered(spark, sf_dir, f):
    return _rows(Q.apply_filter(read_logs(spark, sf_dir), f))


T_START, T_END = "2024-01-01 00:05:00", "2024-01-01 00:10:00"


@query("filter_time_range", BASE + OUT_SQL +
       f" WHERE ts >= {ts_lit(T_START)} AND ts <= {ts_lit(T_END)}")
def q_filter_time_range(spark, sf_dir):
    return _filtered(spark, sf_dir, Q.LogFilter(start=T_START, end=T_END))


@query("filter_severity_text", BASE + OUT_SQL + " WHERE severity_text ILIKE 'warn%'")
def q_filter_severity_text(spark, sf_dir):
    return _filtered(spark, sf_dir, Q.LogFilter(severity_text="warn"))


@query("filter_trace_prefix", BASE + OUT_SQL + " WHERE trace_id ILIKE 'AB%'")
def q_filter_trace_prefix(spark, sf_dir):
    return _filtered(spark, sf_dir, Q.LogFilter(trace_id="AB"))


@query("filter_span_prefix", BASE + OUT_SQL + " WHERE span_id ILIKE 'f%'")
def q_filter_span_prefix(spark, sf_dir):
    return _filtered(spark, sf_dir, Q.LogFilter(span_id="f"))


@query("filter_severity_number", BASE + OUT_SQL + " WHERE severity_number = 18")
def q_filter_severity_number(spark, sf_dir):
    return _filtered(spark, sf_dir, Q.LogFilter(severity_number=18))


@query("filter_errors", BASE + OUT_SQL + " WHERE severity_number >= 17")
def q_filter_errors(spark, sf_dir):
    return _rows(Q.errors_only(read_logs(spark, sf_dir)))


PAGE = dict(service_name="svc-3", body="click", descending=True, limit=50, offset=10)


@query("search_logs", BASE + """
SELECT event_id, ts, service_name, severity_number FROM logs
WHERE service_name ILIKE 'svc-3%' AND body ILIKE '%click%'
ORDER BY ts DESC, trace_id DESC, span_id DESC LIMIT 50 OFFSET 10""")
def q_search_logs(spark, sf_dir):
    return _rows(Q.search_logs(read_logs(spark, sf_dir), Q.LogFilter(**PAGE)))


@query("search_count", BASE + f"""
SELECT count(*) AS total FROM logs
WHERE ts >= {ts_lit(T_START)} AND severity_text ILIKE 'error%'""")
def q_search_count(spark, sf_dir):
    return Q.search_count(read_logs(spark, sf_dir), Q.LogFilter(start=T_START, severity_text="error"))


JSON_PAGE = dict(order_by="ServiceName", descending=False, limit=20, offset=5, severity_text="FATAL")


@query("search_json", BASE + """
, page AS (SELECT * FROM logs WHERE severity_text ILIKE 'FATAL%'
           ORDER BY service_name, trace_id, span_id LIMIT 20 OFFSET 5)
SELECT CAST(row_number() OVER (ORDER BY service_name, trace_id, span_id) - 1 AS INTEGER) AS pos,
       trace_id, span_id, service_name, body, body_type, severity_number, severity_text, scope_name, scope_version,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') || regexp_replace(regexp_replace('.' || lpad(CAST(ts_nanos % 1000000000 AS VARCHAR), 9, '0'), '0+$', ''), '[.]$', '') || 'Z' AS ts,
       strftime(observed_ts, '%Y-%m-%dT%H:%M:%S') || regexp_replace(regexp_replace('.' || lpad(CAST(observed_ts_nanos % 1000000000 AS VARCHAR), 9, '0'), '0+$', ''), '[.]$', '') || 'Z' AS observed,
       log_attr_keys[1] || '=' || log_attr_values[1] || ',' || log_attr_keys[2] || '=' || coalesce(log_attr_values[2], '') AS log_attrs,
       res_attr_keys[1] || '=' || res_attr_values[1] AS res_attrs,
       (SELECT count(*) FROM logs WHERE severity_text ILIKE 'FATAL%') AS total
FROM page""")
def q_search_json(spark, sf_dir):
    doc = Q.search_json(read_logs(spark, sf_dir), Q.LogFilter(**JSON_PAGE))
    # read the document back: every field of every record, and the total
    kv = "array<struct<key string, value string>>"
    parsed = doc.select(F.from_json(
        "json", "data array<struct<traceId string, spanId string, serviceName string, body string, bodyType string,"
                " severityNumber int, severityText string, scopeName string, scopeVersion string, timestamp string,"
                f" observedTimestamp string, logAttributes {kv}, resourceAttributes {kv}>>,"
                " meta struct<totalRowCount bigint>").alias("d"))

    def pairs(c):
        return F.array_join(F.transform(c, lambda a: F.concat(a["key"], F.lit("="), a["value"])), ",")

    names = {"trace_id": "traceId", "span_id": "spanId", "service_name": "serviceName", "body": "body",
             "body_type": "bodyType", "severity_number": "severityNumber", "severity_text": "severityText",
             "scope_name": "scopeName", "scope_version": "scopeVersion", "ts": "timestamp", "observed": "observedTimestamp"}
    return parsed.select(F.posexplode("d.data").alias("pos", "r"), F.col("d.meta.totalRowCount").alias("total")) \
        .select(F.col("pos").cast("int").alias("pos"), *[F.col(f"r.{v}").alias(k) for k, v in names.items()],
                pairs(F.col("r.logAttributes")).alias("log_attrs"), pairs(F.col("r.resourceAttributes")).alias("res_attrs"),
                "total")


@query("unflatten_attrs", BASE + """
SELECT event_id, 'log' AS kind, CAST(i - 1 AS INTEGER) AS pos, log_attr_keys[i] AS key,
       coalesce(log_attr_values[i], '') AS value
FROM (SELECT *, unnest(generate_series(1, len(log_attr_keys))) AS i FROM logs)
UNION ALL
SELECT event_id, 'res' AS kind, CAST(i - 1 AS INTEGER) AS pos, res_attr_keys[i] AS key,
       coalesce(res_attr_values[i], '') AS value
FROM (SELECT *, unnest(generate_series(1, len(res_attr_keys))) AS i FROM logs)""")
def q_unflatten_attrs(spark, sf_dir):
    logs = read_logs(spark, sf_dir)
    both = logs.select("event_id", F.array(
        F.struct(F.lit("log").alias("kind"), unflatten_attrs("log_attr_keys", "log_attr_values").alias("kv")),
        F.struct(F.lit("res").alias("kind"), unflatten_attrs("res_attr_keys", "res_attr_values").alias("kv")),
    ).alias("groups"))
    g = both.select("event_id", F.explode("groups").alias("g"))
    return g.select("event_id", F.col("g.kind").alias("kind"), F.posexplode("g.kv").alias("pos", "a")) \
        .select("event_id", "kind", F.col("pos").cast("int").alias("pos"),
                F.col("a.key").alias("key"), F.col("a.value").alias("value"))
