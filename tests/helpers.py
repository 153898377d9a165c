"""Builders for hand-written test rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from logpond import schema as S


def log_row(ts, service, severity_text, severity_number, body, trace_id, span_id,
            log_attrs=(), res_attrs=None):
    res_attrs = res_attrs if res_attrs is not None else [("service.name", service)]
    return {
        "ts": ts, "ts_nanos": None, "observed_ts": ts, "observed_ts_nanos": None, "inserted_at": None,
        "trace_id": trace_id, "span_id": span_id, "severity_text": severity_text,
        "severity_number": severity_number, "service_name": service, "body": body,
        "body_type": "string", "scope_name": "test", "scope_version": "1.0.0",
        "log_attr_keys": [k for k, _ in log_attrs], "log_attr_values": [v for _, v in log_attrs],
        "res_attr_keys": [k for k, _ in res_attrs], "res_attr_values": [v for _, v in res_attrs],
        "log_date": ts.date(),
    }


def logs_df(spark, rows):
    # build via ISO text so the Python process's zone never applies
    df = spark.createDataFrame(
        [{**r, "ts": r["ts"].isoformat(sep=" "), "observed_ts": r["observed_ts"].isoformat(sep=" "),
          "log_date": r["log_date"].isoformat()} for r in rows],
        "ts string, ts_nanos bigint, observed_ts string, observed_ts_nanos bigint, inserted_at timestamp, trace_id string, "
        "span_id string, severity_text string, severity_number int, service_name string, body string, "
        "body_type string, scope_name string, scope_version string, log_attr_keys array<string>, "
        "log_attr_values array<string>, res_attr_keys array<string>, res_attr_values array<string>, "
        "log_date string")
    return df.select(*[F.col(c).cast(S.LOGS_SCHEMA[c].dataType).alias(c) for c in S.LOG_COLUMNS])


NOW = dt.datetime(2026, 1, 1, 12, 0, 0)

# Search fixture rows: three for test-service, one for payment-service at "now"
R1 = log_row(dt.datetime(2024, 5, 20, 10), "test-service", "ERROR", 17,
             "Failed to process transaction due to timeout", "4bf92f3577b34da6a3ce929d0e0e4736", "00f067aa0ba902b7",
             [("http.method", "POST"), ("http.status_code", "504"), ("retry_count", "3")])
R2 = log_row(dt.datetime(2024, 5, 23, 10), "test-service", "WARNING", 13, "extra information",
             "4bf92f3577b37da6a3ce929d0e0e4736", "00f067aa0ba902b8")
R3 = log_row(dt.datetime(2025, 5, 20, 10), "test-service", "INFO", 9, "Just some test body",
             "8bf92f3577b34da6a3ce929d0e0e4736", "02y067aa0ba902h3")
R4 = log_row(NOW, "payment-service", "ERROR", 17, "Payment processing failed due to server outage.",
             "3e4f5a3577b34da6a3ce929d0e0e4736", "00f067aa0ba902b9")
