"""Registered streaming queries (ST1-ST8, ST10).

Each runs a bounded stream: the envelopes derived from ``events`` are written
as files, the ingest query processes ``FILES_A_TRIGGER`` of them a micro-batch
with an ``availableNow`` trigger, and the batch read of its output tables is
returned. The stream run, with the compaction of its days, is shared by the
keys that only read: they check outputs of one run, and only the first of them
carries its time. Keys that
change a table (retries, retention) run an ingest of their own.
"""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from logpond.operators import search as Q
from logpond.operators.livetail import live_tail_view
from logpond.plans.oracle import logs_cte, metrics_1m_cte, metrics_1s_cte, ts_lit, with_ctes
from logpond.plans.q_decode import _FLAT_SQL, BATCH, _flat_out
from logpond.plans.registry import ntz, query
from logpond.session import payload_session, scratch_path
from logpond.sources import envelopes as E
from logpond.sources.events_adapter import read_logs
from logpond.streaming import ingest as I
from logpond.streaming import livetail as LT

FILES_A_TRIGGER = 4
#: The envelopes that arrive last, in one file.
LAST_ENVELOPES = 50
_RUNS: dict = {}
_LOCK = threading.Lock()


def _envelopes(spark, sf_dir, clock="dense"):
    """JSON and protobuf requests by turns, plain, gzip and zstd."""
    logs = read_logs(payload_session(spark), sf_dir, clock).withColumn("batch_id", F.expr(f"event_id div {BATCH}"))
    b = F.col("batch_id")
    ct = F.when(b % 2 == 0, F.lit("application/json")).otherwise(F.lit("application/x-protobuf"))
    enc = F.element_at(F.array(F.lit(""), F.lit("gzip"), F.lit("zstd")), (b % 3 + 1).cast("int"))
    return E.to_envelopes(E.otlp_export(logs, "batch_id"), ct, enc)


def _by_arrival(env):
    """The envelopes in files by arrival, as a queue stores them (a micro-batch
    then writes to few hours), and the last ones for a file of their own. The
    table is read by all tasks for both."""
    newest = env.agg(F.max("batch_id").alias("b")).first()["b"]
    late = F.col("batch_id") > (newest if newest is not None else 0) - LAST_ENVELOPES
    return env.where(~late).repartitionByRange("batch_id"), env.where(late).repartition(1)


def _run(env) -> str:
    """An ingest of these envelopes; the last ones arrive after all others."""
    spark = env.sparkSession
    src, out = scratch_path(spark, "ingest_src"), scratch_path(spark, "ingest_out")
    staged = scratch_path(spark, "ingest_staged")
    env.write.parquet(staged)
    early, late = _by_arrival(E.read_envelopes(spark, staged))
    early.write.parquet(src)
    late.write.mode("append").parquet(src)
    I.start_ingest(spark, src, out, available_now=True, max_files_per_trigger=FILES_A_TRIGGER).awaitTermination()
    return out


def _ingest_run(spark, sf_dir) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    with _LOCK:
        if key not in _RUNS:
            out = _run(_envelopes(spark, sf_dir))
            days = I.read_stream_logs(spark, out).select("log_date").distinct().collect()
            I.compact_logs(spark, out, [str(r["log_date"]) for r in days])
            _RUNS[key] = out
        return _RUNS[key]


@query("stream_ingest", _FLAT_SQL)
def q_stream_ingest(spark, sf_dir):
    return _flat_out(I.read_stream_logs(spark, _ingest_run(spark, sf_dir)))


M = with_ctes(logs_cte(), metrics_1s_cte(), metrics_1m_cte())


@query("stream_metrics_1s", M + "SELECT ts, service_name, logs_count, errors_count FROM m1s")
def q_stream_metrics_1s(spark, sf_dir):
    m = I.read_metrics(spark, _ingest_run(spark, sf_dir), "1s")
    return m.select(ntz("ts"), "service_name", "logs_count", "errors_count")


@query("stream_metrics_1m", M + "SELECT ts, service_name, logs_count, errors_count FROM m1m")
def q_stream_metrics_1m(spark, sf_dir):
    m = I.read_metrics(spark, _ingest_run(spark, sf_dir), "1m")
    return m.select(ntz("ts"), "service_name", "logs_count", "errors_count")


@query("stream_registry", with_ctes(logs_cte()) + """
SELECT service_name, CAST(min(date_trunc('second', ts)) AS TIMESTAMP) AS first_seen,
       CAST(max(date_trunc('second', ts)) AS TIMESTAMP) AS last_seen
FROM logs GROUP BY service_name""")
def q_stream_registry(spark, sf_dir):
    r = I.read_registry(spark, _ingest_run(spark, sf_dir))
    return r.select("service_name", ntz("first_seen"), ntz("last_seen"))


LIVE = dict(services=("svc-0", "svc-3", "svc-5", "svc-6"), severities=("info", "fatal", "warn"), term="")


# the newest arrivals are the last envelopes, 100 events each
@query("stream_live_tail", with_ctes(logs_cte()) + """
, buf AS (SELECT * FROM logs ORDER BY event_id DESC LIMIT 300)
SELECT trace_id, ts, service_name FROM buf
WHERE service_name IN ('svc-0', 'svc-3', 'svc-5', 'svc-6') AND severity_text IN ('INFO', 'FATAL', 'WARNING')
ORDER BY ts DESC, event_id DESC LIMIT 15""")
def q_stream_live_tail(spark, sf_dir):
    out, seen = _ingest_run(spark, sf_dir), scratch_path(spark, "tail")
    q = LT.start_live_tail(spark, out, seen + "_checkpoint", lambda ring: ring.write.mode("overwrite").parquet(seen))
    q.awaitTermination()
    v = live_tail_view(spark.read.parquet(seen), "arrival_seq", **LIVE)
    return v.select("trace_id", ntz("ts"), "service_name")


@query("stream_retry", with_ctes(logs_cte()) + """
SELECT service_name, count(*) AS records, count(DISTINCT trace_id) AS distinct_records,
       CAST(sum(count(*)) OVER () AS BIGINT) AS in_rollups FROM logs GROUP BY service_name""")
def q_stream_retry(spark, sf_dir):
    """ST3 + ST7: the rollups of the first attempt fail after the rows are
    written, the batch is retried when it is due: one copy everywhere."""
    spark = payload_session(spark)
    root = scratch_path(spark, "retried")
    paths = I.IngestPaths(root)
    staged = scratch_path(spark, "retried_src")
    _envelopes(spark, sf_dir).write.parquet(staged)
    env = E.read_envelopes(spark, staged)
    half = F.col("batch_id") % 2 == 0
    I.process_batch(env.where(half), 0, paths, "2024-01-01 00:00:00", rollups=_no_rollups)
    I.process_batch(env.where(~half), 1, paths, "2024-01-01 00:00:01")
    I.process_batch(env.limit(0), 2, paths, "2024-01-01 00:10:00")
    logs = I.read_stream_logs(spark, root)
    counted = I.read_metrics(spark, root, "1s").agg(F.sum("logs_count").alias("in_rollups"))
    by = logs.groupBy("service_name").agg(F.count("*").alias("records"), F.countDistinct("trace_id").alias("distinct_records"))
    return by.withColumn("in_rollups", F.lit(counted.first()["in_rollups"]).cast("bigint"))


def _no_rollups(*_):
    raise OSError("the rollup table cannot be written")


RET_AS_OF = "2024-01-31 00:00:00"


@query("retention_logs", with_ctes(logs_cte(clock="wide")) + f"""
SELECT trace_id, ts FROM logs WHERE ts > {ts_lit(RET_AS_OF)} - INTERVAL 7 DAY""")
def q_retention_logs(spark, sf_dir):
    out = _run(_envelopes(spark, sf_dir, "wide"))
    I.expire_logs(spark, out, RET_AS_OF, "7 days")
    I.vacuum(spark, out)
    return I.read_stream_logs(spark, out).select("trace_id", ntz("ts"))


# ---- searches of the ingested table -----------------------------------------

LOGS = with_ctes(logs_cte())


@query("filter_service_prefix", LOGS + """
SELECT trace_id, ts, service_name, severity_number FROM logs WHERE service_name ILIKE 'SVC-1%'""")
def q_filter_service_prefix(spark, sf_dir):
    out = _ingest_run(spark, sf_dir)
    rows = Q.apply_filter(I.read_stream_logs(spark, out), Q.LogFilter(service_name="SVC-1"), I.read_registry(spark, out))
    return rows.select("trace_id", ntz("ts"), "service_name", "severity_number")


BODY = "PURCHASE by user 4_ "


# '_' is a one-character wildcard, as in the service
@query("filter_body_contains", LOGS + f"""
SELECT trace_id, ts, service_name, severity_number FROM logs WHERE body ILIKE '%{BODY}%'""")
def q_filter_body_contains(spark, sf_dir):
    """F8 on the compacted table: files that cannot hold the term are skipped."""
    out = _ingest_run(spark, sf_dir)
    rows = Q.apply_filter(I.read_stream_logs(spark, out, body=BODY), Q.LogFilter(body=BODY))
    return rows.select("trace_id", ntz("ts"), "service_name", "severity_number")


PAGES = 6


@query("search_pages", LOGS + """
, f AS (SELECT * FROM logs WHERE severity_number >= 17)
SELECT trace_id, ts, service_name,
       CAST((row_number() OVER (ORDER BY service_name DESC, event_id DESC) - 1) // greatest(1, (count(*) OVER () + 5) // 6) AS INTEGER) AS page
FROM f""")
def q_search_pages(spark, sf_dir):
    """All pages of the errors by service, newest event first, from page
    to page by token. The ids are zeros, as of records without a trace."""
    zeros = read_logs(spark, sf_dir).where("severity_number >= 17").select(
        "*", F.col("trace_id").alias("own_id")).withColumns(
        {"trace_id": F.lit("0" * 32), "span_id": F.lit("0" * 16)})
    limit = max(1, -(-zeros.count() // PAGES))
    f = Q.LogFilter(order_by="ServiceName", descending=True, limit=limit)
    token, out = None, None
    for k in range(PAGES + 1):
        path = scratch_path(spark, "page")
        Q.search_page(zeros, f, token).withColumn("page", F.lit(k)).write.parquet(path)
        page = spark.read.parquet(path)
        out = page if out is None else out.unionByName(page)
        last = Q.last_rows(page, f)
        if not last:
            break
        token = Q.next_token(last, token)
    return out.select(F.col("own_id").alias("trace_id"), ntz("ts"), "service_name", "page")
