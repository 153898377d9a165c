"""Registered storage queries: sink / scan round trips, id check, sizes,
outlook, disk cards and retention (S4-S6, S11, A14-A17, ST8, ST9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logpond import schema as S
from logpond.operators import rollups as R
from logpond.operators import search as Q
from logpond.operators import storage as ST
from logpond.plans.oracle import logs_cte, metrics_1m_cte, metrics_1s_cte, ts_lit, with_ctes
from logpond.plans.registry import ntz, query
from logpond.session import scratch_path
from logpond.sources.events_adapter import read_logs
from logpond.sources.tables import read_table

BASE = with_ctes(logs_cte())
WIDE = with_ctes(logs_cte(clock="wide"))


def _write(spark, sf_dir, clock="dense", name="logs"):
    path = scratch_path(spark, name)
    ST.write_logs(read_logs(spark, sf_dir, clock).drop("event_id"), path)
    return path


@query("logs_sink_roundtrip", BASE + """
SELECT trace_id, span_id, ts, service_name, severity_text, severity_number, body, log_date,
       CAST(len(log_attr_keys) AS INTEGER) AS n_log_attrs FROM logs""")
def q_logs_sink_roundtrip(spark, sf_dir):
    t = ST.read_logs_table(spark, _write(spark, sf_dir))
    return t.select("trace_id", "span_id", ntz("ts"), "service_name", "severity_text", "severity_number",
                    "body", "log_date", F.size("log_attr_keys").alias("n_log_attrs"))


SCAN = dict(start="2024-01-10 00:00:00", end="2024-01-12 12:00:00", severity_text="ERR")


@query("logs_scan", WIDE + """
SELECT trace_id, ts, service_name FROM logs
WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 12:00:00'
  AND severity_text ILIKE 'ERR%'""")
def q_logs_scan(spark, sf_dir):
    t = ST.read_logs_table(spark, _write(spark, sf_dir, "wide"))
    return Q.apply_filter(t, Q.LogFilter(**SCAN)).select("trace_id", ntz("ts"), "service_name")


@query("validate_ids", BASE + """
SELECT event_id, event_id % 11 <> 0 AS valid, count(*) FILTER (WHERE event_id % 11 <> 0) OVER () AS n_valid,
       count(*) FILTER (WHERE event_id % 11 = 0) OVER () AS n_invalid FROM logs""")
def q_validate_ids(spark, sf_dir):
    logs = read_logs(spark, sf_dir).withColumn(
        "trace_id", F.when(F.col("event_id") % 11 == 0, F.substring("trace_id", 1, 31)).otherwise(F.col("trace_id")))
    good, bad = ST.validate_ids(logs, strict=False)
    n = ST.id_check_counts(logs).select(F.col("valid").alias("n_valid"), F.col("invalid").alias("n_invalid"))
    both = good.select("event_id", F.lit(True).alias("valid")).unionByName(bad.select("event_id", F.lit(False).alias("valid")))
    return both.join(F.broadcast(n), F.lit(True))


@query("load_if_empty", BASE + """
SELECT 1 AS call, CAST(count(*) AS BIGINT) AS row_count, true AS loaded FROM logs
UNION ALL SELECT 2, CAST(count(*) AS BIGINT), false FROM logs""")
def q_load_if_empty(spark, sf_dir):
    path = scratch_path(spark, "seeded")
    rows = read_logs(spark, sf_dir).drop("event_id")
    out = []
    for call in (1, 2):
        loaded = ST.load_if_empty(spark, path, rows)
        out.append(ST.read_logs_table(spark, path).agg(
            F.lit(call).alias("call"), F.count(F.lit(1)).alias("row_count"), F.lit(loaded).alias("loaded")))
    return out[0].unionByName(out[1])


@query("partition_bytes", WIDE + """
SELECT log_date, CAST(sum(strlen(body)) AS BIGINT) AS partition_bytes FROM logs GROUP BY 1""")
def q_partition_bytes(spark, sf_dir):
    return ST.partition_bytes(read_logs(spark, sf_dir, "wide"), F.octet_length("body"))


_OUTLOOK_SQL = WIDE + """
, p AS (SELECT log_date, CAST(sum(strlen(body)) AS BIGINT) AS b FROM logs GROUP BY 1)
, s AS (SELECT 'all' AS scenario, * FROM p UNION ALL
        SELECT 'ttl90' AS scenario, * FROM p)
, n AS (SELECT *, CASE scenario WHEN 'all' THEN 30 ELSE 90 END AS ttl FROM s)
, o AS (SELECT scenario, ttl, CAST(sum(b) AS BIGINT) AS current_total_bytes,
       CAST(count(*) AS INTEGER) AS days_of_history, count(*) >= ttl AS is_steady_state,
       CAST(CASE WHEN count(*) >= ttl THEN sum(b)
            WHEN count(*) > 1 THEN ((sum(b) - max_by(b, log_date)) // (count(*) - 1)) * ttl
            ELSE sum(b) * ttl END AS BIGINT) AS projected_steady_state_bytes
       FROM n GROUP BY scenario, ttl)
"""


#: a history as long as the retention, and one that is still growing
TTL_DAYS = {"all": 30, "ttl90": 90}


def _outlook(spark, sf_dir, scenario):
    parts = ST.partition_bytes(read_logs(spark, sf_dir, "wide"), F.octet_length("body"))
    return ST.storage_outlook(parts, TTL_DAYS[scenario])


@query("storage_outlook", _OUTLOOK_SQL + "SELECT * EXCLUDE (ttl) FROM o")
def q_storage_outlook(spark, sf_dir):
    return (_outlook(spark, sf_dir, "all").select(F.lit("all").alias("scenario"), "*")
            .unionByName(_outlook(spark, sf_dir, "ttl90").select(F.lit("ttl90").alias("scenario"), "*")))


def _disks(spark, sf_dir):
    """A disk per part: its size in times of the logs' bytes is the part's
    size, its free share the last two digits of the part's key."""
    logs = read_logs(spark, sf_dir, "wide")
    table = logs.agg(F.sum(F.octet_length("body")).cast("bigint").alias("b"))
    parts = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("size"))
    total = F.col("size") * F.col("b")
    return parts.join(F.broadcast(table), F.lit(True)).select(
        F.concat(F.lit("disk-"), F.col("p_partkey")).alias("disk_name"),
        F.expr("size * b * (p_partkey % 100) div 100").alias("free_bytes"), total.alias("total_bytes"))


_DISK_SQL = """
, t AS (SELECT CAST(sum(strlen(body)) AS BIGINT) AS b FROM logs)
, d AS (SELECT 'disk-' || p_partkey AS disk_name, CAST((p_size * b * (p_partkey % 100)) // 100 AS BIGINT) AS free_bytes,
               CAST(p_size * b AS BIGINT) AS total_bytes FROM part, t)
"""


@query("disk_usage", WIDE + _DISK_SQL + """
SELECT disk_name, free_bytes, total_bytes,
       round_even((total_bytes - free_bytes) / total_bytes * 100, 2) AS used_percent FROM d""")
def q_disk_usage(spark, sf_dir):
    return ST.disk_usage(_disks(spark, sf_dir))


@query("storage_runway", _OUTLOOK_SQL + _DISK_SQL + f"""
, j AS (SELECT o.scenario, d.*, o.projected_steady_state_bytes AS projected,
               (d.total_bytes - d.free_bytes) AS used FROM o, d)
, c AS (SELECT *, (projected - used) / CAST(CASE scenario WHEN 'all' THEN 30 ELSE 90 END AS DOUBLE) AS growth FROM j)
SELECT scenario, disk_name, printf('%.0f', round_even(used / total_bytes * 100, 0)) AS value, '%' AS unit,
  CASE WHEN projected <= used THEN '{S.RUNWAY_STABLE}'
       WHEN free_bytes / growth > {S.RUNWAY_WARNING_DAYS} THEN '~' || printf('%.0f', round_even(free_bytes / growth, 0)) || '{S.RUNWAY_DAYS}'
       ELSE '~' || printf('%.0f', round_even(free_bytes / growth, 0)) || '{S.RUNWAY_ACTION}' END AS delta,
  CASE WHEN projected <= used THEN 'stable' WHEN free_bytes / growth > {S.RUNWAY_WARNING_DAYS} THEN 'growing' ELSE 'action' END AS level,
  CASE WHEN projected > used THEN free_bytes / growth END AS days_remaining
FROM c""")
def q_storage_runway(spark, sf_dir):
    disks = _disks(spark, sf_dir)
    both = [ST.storage_runways(disks, _outlook(spark, sf_dir, k), ttl).select(F.lit(k).alias("scenario"), "*")
            for k, ttl in TTL_DAYS.items()]
    return both[0].unionByName(both[1])


RET_AS_OF = "2024-01-31 00:00:00"


MET_AS_OF = "2024-01-01 01:10:00"


@query("retention_metrics", BASE.rstrip() + ",\n" + metrics_1s_cte() + ",\n" + metrics_1m_cte() + f"""
SELECT '1s' AS tbl, ts, service_name, logs_count, errors_count FROM m1s
WHERE ts > {ts_lit(MET_AS_OF)} - INTERVAL 1 HOUR
UNION ALL
SELECT '1m' AS tbl, ts, service_name, logs_count, errors_count FROM m1m
WHERE ts > {ts_lit(MET_AS_OF)} - INTERVAL 1 DAY""")
def q_retention_metrics(spark, sf_dir):
    m1s = R.metrics_1s(read_logs(spark, sf_dir))
    m1m = R.metrics_1m(m1s)
    a = ST.retention_view(m1s, MET_AS_OF, "1 hour").select(F.lit("1s").alias("tbl"), "*")
    b = ST.retention_view(m1m, MET_AS_OF, "1 day").select(F.lit("1m").alias("tbl"), "*")
    return a.unionByName(b).select("tbl", ntz("ts"), "service_name", "logs_count", "errors_count")


#: caps as shares of what the age limits leave
RAW_SHARE, DLQ_SHARE = 3, 2


@query("retention_bytes", f"""
WITH m AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, strlen(props) AS s FROM events),
raw AS (SELECT event_id, sum(s) OVER () // {RAW_SHARE} AS cap,
               sum(s) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS run
        FROM m WHERE ts > {ts_lit(RET_AS_OF)} - INTERVAL 12 DAY),
dlq AS (SELECT event_id, sum(s) OVER () // {DLQ_SHARE} AS cap,
               sum(s) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS run
        FROM m WHERE ts > {ts_lit(RET_AS_OF)} - INTERVAL 24 DAY AND event_id % 13 >= 10)
SELECT 'raw' AS queue, event_id AS msg_id FROM raw WHERE run <= cap
UNION ALL SELECT 'dlq' AS queue, event_id AS msg_id FROM dlq WHERE run <= cap""")
def q_retention_bytes(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"), F.col("ts").cast("timestamp").alias("received_at"),
        F.octet_length("props").alias("size"), "props")

    def capped(queue, rows, age, share):
        total = ST.retention_view(rows, RET_AS_OF, age, "received_at").agg(F.sum("size").alias("n")).first()["n"]
        return ST.retention_bytes(rows, RET_AS_OF, age, (total or 0) // share).select(F.lit(queue).alias("queue"), "msg_id")

    return capped("raw", ev, "12 days", RAW_SHARE).unionByName(
        capped("dlq", ev.filter(F.col("msg_id") % 13 >= 10), "24 days", DLQ_SHARE))
