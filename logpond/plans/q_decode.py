"""Registered decode / flatten / envelope queries.

Envelopes are built from the adapter rows: one OTLP request per
``event_id div 100`` (S12), wrapped with headers chosen by the batch number.
Decoding them must give back exactly the adapter rows, so the oracle is the
adapter SQL itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from logpond.functions import values as V
from logpond.sources import codecs
from logpond.sources import envelopes as E
from logpond.sources.events_adapter import dense_micros, logs_from_events, read_logs
from logpond.sources.tables import read_table
from logpond.plans.oracle import logs_cte, with_ctes
from logpond.plans.registry import ntz, query
from logpond.session import payload_session, scratch_path

BATCH = 100
BASE = with_ctes(logs_cte())


def _requests(spark, sf_dir, batch: int = BATCH):
    logs = read_logs(payload_session(spark), sf_dir).withColumn("batch_id", F.expr(f"event_id div {batch}"))
    return E.otlp_export(logs, "batch_id")


def _mixed_headers():
    b = F.col("batch_id") % 6
    ct = (F.when(b == 4, F.lit("text/plain"))
          .when(b.isin(2, 3), F.lit("application/x-protobuf"))
          .when(b == 5, F.lit("application/json; charset=utf-8"))
          .otherwise(F.lit("application/json")))
    enc = (F.when(b == 1, F.lit("gzip")).when(b == 2, F.lit("zstd")).when(b == 3, F.lit("identity"))
           .when(b == 5, F.lit("br")).otherwise(F.lit("")))
    return ct, enc


_MIXED_SQL = """
, b AS (SELECT DISTINCT event_id // 100 AS batch_id FROM events)
, h AS (SELECT batch_id,
          CASE batch_id % 6 WHEN 4 THEN 'text/plain' WHEN 2 THEN 'application/x-protobuf'
               WHEN 3 THEN 'application/x-protobuf' WHEN 5 THEN 'application/json; charset=utf-8'
               ELSE 'application/json' END AS content_type,
          CASE batch_id % 6 WHEN 1 THEN 'gzip' WHEN 2 THEN 'zstd' WHEN 3 THEN 'identity'
               WHEN 5 THEN 'br' ELSE '' END AS content_encoding
        FROM b)
"""


def _mixed_envelopes(spark, sf_dir):
    ct, enc = _mixed_headers()
    return E.to_envelopes(_requests(spark, sf_dir), ct, enc)


@query("otlp_envelopes", BASE + _MIXED_SQL + """
SELECT batch_id, content_type, content_encoding, 1 AS num_delivered FROM h""")
def q_otlp_envelopes(spark, sf_dir):
    # Write the envelopes as a table in the shared folder, read them back
    path = scratch_path(spark, "envelopes")
    _mixed_envelopes(spark, sf_dir).write.parquet(path)
    env = E.read_envelopes(spark, path)
    return env.select("batch_id", "content_type", "content_encoding", "num_delivered")


@query("admit_envelopes", BASE + _MIXED_SQL + """
SELECT batch_id, batch_id % 6 NOT IN (4, 5) AS accepted,
       CASE batch_id % 6 WHEN 4 THEN 'Unsupported or Missing Content-Type: text/plain'
                         WHEN 5 THEN 'Unsupported Content-Encoding: br' END AS reject_reason
FROM h""")
def q_admit_envelopes(spark, sf_dir):
    return E.admit_envelopes(_mixed_envelopes(spark, sf_dir)).select("batch_id", "accepted", "reject_reason")


@query("sniff_compression", BASE + _MIXED_SQL + """
SELECT batch_id, CASE batch_id % 6 WHEN 1 THEN 'gzip' WHEN 2 THEN 'zstd' ELSE 'none' END AS detected FROM h""")
def q_sniff_compression(spark, sf_dir):
    return _mixed_envelopes(spark, sf_dir).select("batch_id", codecs.sniff_compression("payload").alias("detected"))


@query("decompress_payloads", """
SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents""")
def q_decompress_payloads(spark, sf_dir):
    """Document texts, by turns plain, gzip and zstd; every other compressed
    payload in two members or frames."""
    m = F.col("doc_id") % 3
    enc = F.element_at(F.array(F.lit("identity"), F.lit("gzip"), F.lit("zstd")), (m + 1).cast("int"))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    cut = F.when((F.col("doc_id") % 2 == 0) & (m > 0), F.floor(F.octet_length("raw") / 2)).otherwise(F.octet_length("raw")).cast("int")
    d = read_table(payload_session(spark), sf_dir, "documents").select("doc_id", enc.alias("enc"), raw.alias("raw")).withColumn("cut", cut)
    d = d.select("doc_id", "enc", F.expr("substring(raw, 1, cut)").alias("a"), F.expr("substring(raw, cut + 1)").alias("b"))
    d = d.select("doc_id", "enc", F.concat(codecs.compress("a", "enc"), F.when(
        F.octet_length("b") > 0, codecs.compress("b", "enc")).otherwise(F.lit(b"").cast("binary"))).alias("payload"))
    out = d.select("doc_id", codecs.decompress("payload", "enc").alias("d"))
    return out.select("doc_id", F.octet_length("d.payload").cast("bigint").alias("n_bytes"),
                      F.md5("d.payload").alias("digest"))


_FLAT_COLS = ["trace_id", "span_id", "ts", "ts_nanos", "observed_ts", "observed_ts_nanos", "severity_text", "severity_number",
              "service_name", "body", "body_type", "scope_name", "scope_version", "log_date"]
_FLAT_SQL = BASE + "SELECT " + ", ".join(_FLAT_COLS) + " FROM logs"


def _flat_out(df):
    return df.select(*[ntz(c) if c in ("ts", "observed_ts") else F.col(c) for c in _FLAT_COLS])


def _decoded_logs(spark, sf_dir, content_type, batch: int = BATCH):
    enc = F.element_at(F.array(F.lit(""), F.lit("gzip"), F.lit("zstd")), (F.col("batch_id") % 3 + 1).cast("int"))
    ct = F.lit(content_type) if isinstance(content_type, str) else content_type
    env = E.to_envelopes(_requests(spark, sf_dir, batch), ct, enc)
    logs, _ = E.envelopes_to_logs(env)
    return logs


@query("otlp_flatten", _FLAT_SQL)
def q_otlp_flatten(spark, sf_dir):
    return _flat_out(_decoded_logs(spark, sf_dir, "application/json"))


@query("otlp_flatten_proto", _FLAT_SQL)
def q_otlp_flatten_proto(spark, sf_dir):
    return _flat_out(_decoded_logs(spark, sf_dir, "application/x-protobuf"))


LARGE_BATCH = 5000


@query("otlp_flatten_large", _FLAT_SQL)
def q_otlp_flatten_large(spark, sf_dir):
    """Requests as collectors send them: thousands of records each, JSON and
    protobuf by turns."""
    ct = F.when(F.col("batch_id") % 2 == 0, "application/json").otherwise("application/x-protobuf")
    return _flat_out(_decoded_logs(spark, sf_dir, ct, LARGE_BATCH))


@query("attr_arrays", BASE + """
SELECT trace_id, CAST(i - 1 AS INTEGER) AS pos, log_attr_keys[i] AS key, log_attr_values[i] AS value
FROM (SELECT *, unnest(generate_series(1, len(log_attr_keys))) AS i FROM logs)""")
def q_attr_arrays(spark, sf_dir):
    logs = _decoded_logs(spark, sf_dir, "application/json")
    z = logs.select("trace_id", F.posexplode(F.arrays_zip("log_attr_keys", "log_attr_values")).alias("pos", "kv"))
    return z.select("trace_id", F.col("pos").cast("int").alias("pos"),
                    F.col("kv.log_attr_keys").alias("key"), F.col("kv.log_attr_values").alias("value"))


@query("quarantine_split", BASE + """
SELECT DISTINCT event_id // 100 AS batch_id,
       CASE WHEN (event_id // 100) % 7 = 0 THEN 'quarantine' ELSE 'ok' END AS status FROM logs""")
def q_quarantine_split(spark, sf_dir):
    req = _requests(spark, sf_dir)
    # every 7th payload is cut short
    cut = req.withColumn("json", F.when(F.col("batch_id") % 7 == 0,
                                        F.expr("substr(json, 1, length(json) div 2)")).otherwise(F.col("json")))
    env = E.to_envelopes(cut, F.lit("application/json"), F.lit("gzip"))
    decoded = E.decode_envelopes(env)
    return decoded.select("batch_id", F.when(F.col("decode_error").isNull(), F.lit("ok"))
                          .otherwise(F.lit("quarantine")).alias("status"))


@query("otlp_export", BASE + """
SELECT event_id // 100 AS batch_id, service_name AS service, scope_name AS scope, trace_id, span_id,
       CAST(ts_nanos AS VARCHAR) AS time_nanos, CAST(observed_ts_nanos AS VARCHAR) AS observed_nanos,
       severity_text, severity_number, body, array_to_string(log_attr_keys, ',') AS attr_keys,
       array_to_string(log_attr_values, ',') AS attr_values
FROM logs""")
def q_otlp_export(spark, sf_dir):
    req = _requests(spark, sf_dir)
    kv = "array<struct<key: string, value: struct<stringValue: string>>>"
    rec = ("struct<timeUnixNano: string, observedTimeUnixNano: string, severityNumber: int, severityText: string, "
           f"body: struct<stringValue: string>, attributes: {kv}, traceId: string, spanId: string>")
    parsed = req.select("batch_id", F.from_json(
        "json", f"resourceLogs array<struct<resource: struct<attributes: {kv}>, "
                f"scopeLogs: array<struct<scope: struct<name: string>, logRecords: array<{rec}>>>>>").alias("r"))
    rl = parsed.select("batch_id", F.explode("r.resourceLogs").alias("rl"))
    sl = rl.select("batch_id", F.col("rl.resource.attributes")[0]["value"]["stringValue"].alias("service"),
                   F.explode("rl.scopeLogs").alias("sl"))
    r = sl.select("batch_id", "service", F.col("sl.scope.name").alias("scope"), F.explode("sl.logRecords").alias("r"))
    return r.select("batch_id", "service", "scope", F.col("r.traceId").alias("trace_id"), F.col("r.spanId").alias("span_id"),
                    F.col("r.timeUnixNano").alias("time_nanos"), F.col("r.observedTimeUnixNano").alias("observed_nanos"),
                    F.col("r.severityText").alias("severity_text"), F.col("r.severityNumber").alias("severity_number"),
                    F.col("r.body.stringValue").alias("body"),
                    F.array_join("r.attributes.key", ",").alias("attr_keys"),
                    F.array_join("r.attributes.value.stringValue", ",").alias("attr_values"))


# -- per-field rules on rows built straight from events ----------------------
def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events")


@query("service_name_default", BASE + """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown'
                      ELSE service_name END AS service_name FROM logs""")
def q_service_name_default(spark, sf_dir):
    logs = read_logs(spark, sf_dir)
    m = F.col("event_id") % 5
    svc = F.col("service_name")
    keys = (F.when(m == 0, F.array(F.lit("host.name")))
            .when(m == 1, F.array(F.lit("service.name"), F.lit("host.name")))
            .when(m == 2, F.array(F.lit("service.name"), F.lit("service.name")))
            .when(m == 3, F.array(F.lit("service.name"), F.lit("service.name")))
            .otherwise(F.array(F.lit("service.name"))))
    vals = (F.when(m == 0, F.array(F.lit("h1")))
            .when(m == 1, F.array(F.lit(""), F.lit("h1")))
            .when(m == 2, F.array(F.lit("other"), svc))
            .when(m == 3, F.array(svc, F.lit("")))
            .otherwise(F.array(svc)))
    return logs.select("event_id", V.service_name_from(keys, vals).alias("service_name"))


BATCH_TIME = "2024-02-01 00:00:00"


@query("time_default", BASE + f"""
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN TIMESTAMP '{BATCH_TIME}' ELSE ts END AS ts FROM logs""")
def q_time_default(spark, sf_dir):
    ev = _events(spark, sf_dir)
    m = F.col("event_id") % 5
    nanos = F.when(m == 0, F.lit(0)).when(m == 1, F.lit(None)).otherwise(dense_micros("event_id") * 1000)
    batch = F.unix_micros(F.lit(BATCH_TIME).cast("timestamp")) * 1000
    return ev.select("event_id", ntz(V.nanos_to_ts(V.default_time_nanos(nanos.cast("bigint"), batch)), "ts"))


@query("attr_to_text", """
SELECT event_id, CAST(event_id % 7 AS INTEGER) AS kind,
  CASE event_id % 7
    WHEN 0 THEN event_type
    WHEN 1 THEN CAST(user_id AS VARCHAR)
    WHEN 2 THEN regexp_replace(CAST(value AS VARCHAR), '\\.0$', '')
    WHEN 3 THEN CASE WHEN value > 50 THEN 'true' ELSE 'false' END
    WHEN 4 THEN to_base64(encode(event_type))
    WHEN 5 THEN '["' || event_type || '",' || CAST(user_id AS VARCHAR) || ']'
    ELSE '{"type":"' || event_type || '","user":' || CAST(user_id AS VARCHAR) || '}'
  END AS text
FROM events""")
def q_attr_to_text(spark, sf_dir):
    ev = _events(spark, sf_dir)
    k = F.col("event_id") % 7
    null_s = F.lit(None).cast("string")
    arr = F.to_json(F.struct(F.array(
        F.struct(F.col("event_type").alias("stringValue"), null_s.alias("intValue")),
        F.struct(null_s.alias("stringValue"), F.col("user_id").cast("string").alias("intValue"))).alias("values")))
    kvl = F.to_json(F.struct(F.array(
        F.struct(F.lit("type").alias("key"), F.struct(F.col("event_type").alias("stringValue")).alias("value")),
        F.struct(F.lit("user").alias("key"), F.struct(F.col("user_id").cast("string").alias("stringValue"),
                                                      ).alias("value"))).alias("values")))
    # the kvlist's second value is an int in OTLP/JSON form
    kvl = F.regexp_replace(kvl, r'"stringValue":"([0-9]+)"', '"intValue":"$1"')
    v = F.struct(
        F.when(k == 0, F.col("event_type")).otherwise(null_s).alias("stringValue"),
        F.when(k == 3, F.col("value") > 50).alias("boolValue"),
        F.when(k == 1, F.col("user_id").cast("string")).otherwise(null_s).alias("intValue"),
        F.when(k == 2, F.col("value")).alias("doubleValue"),
        F.when(k == 5, arr).otherwise(null_s).alias("arrayValue"),
        F.when(k == 6, kvl).otherwise(null_s).alias("kvlistValue"),
        F.when(k == 4, F.base64(F.encode("event_type", "UTF-8"))).otherwise(null_s).alias("bytesValue"),
    ).cast(V.ANY_VALUE_TYPE)
    return ev.select("event_id", k.cast("int").alias("kind"), V.any_value_text(v).alias("text"))


@query("id_hex", """
SELECT event_id,
  CASE WHEN event_id % 9 = 0 THEN repeat('0', 32) ELSE md5(CAST(event_id AS VARCHAR)) END AS trace_hex,
  CASE WHEN event_id % 9 = 0 THEN repeat('0', 16) ELSE substr(md5('s' || CAST(event_id AS VARCHAR)), 1, 16) END AS span_hex
FROM events""")
def q_id_hex(spark, sf_dir):
    ev = _events(spark, sf_dir)
    empty = F.col("event_id") % 9 == 0
    trace_raw = F.when(empty, F.lit(b"").cast("binary")).otherwise(F.unhex(F.md5(F.col("event_id").cast("string"))))
    span_raw = F.when(empty, F.lit(None).cast("binary")).otherwise(
        F.unhex(F.substring(F.md5(F.concat(F.lit("s"), F.col("event_id").cast("string"))), 1, 16)))
    return ev.select("event_id", V.id_hex(trace_raw, 16).alias("trace_hex"), V.id_hex(span_raw, 8).alias("span_hex"))




# -- typed attribute values through the whole decode path --------------------
def _typed_attributes():
    null_s = F.lit(None).cast("string")
    any_t = ("struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean, "
             "kvlistValue: struct<values: array<struct<key: string, value: struct<stringValue: string, "
             "intValue: string>>>>>")

    def val(s=None, i=None, d=None, b=None, kv=None):
        return F.struct(
            (s if s is not None else null_s).alias("stringValue"),
            (i if i is not None else null_s).alias("intValue"),
            (d if d is not None else F.lit(None).cast("double")).alias("doubleValue"),
            (b if b is not None else F.lit(None).cast("boolean")).alias("boolValue"),
            (kv if kv is not None else F.lit(None).cast(
                "struct<values: array<struct<key: string, value: struct<stringValue: string, intValue: string>>>>"))
            .alias("kvlistValue")).cast(any_t)

    ctx = F.struct(F.array(
        F.struct(F.lit("user").alias("key"), F.struct(null_s.alias("stringValue"),
                                                      F.col("user_id").cast("string").alias("intValue")).alias("value")),
        F.struct(F.lit("type").alias("key"), F.struct(F.col("event_type").alias("stringValue"),
                                                      null_s.alias("intValue")).alias("value"))).alias("values"))
    return F.array(
        F.struct(F.lit("event.type").alias("key"), val(s=F.col("event_type")).alias("value")),
        F.struct(F.lit("k").alias("key"), val(i=F.get_json_object("props", "$.k")).alias("value")),
        F.struct(F.lit("value").alias("key"), val(d=F.col("value")).alias("value")),
        F.struct(F.lit("big").alias("key"), val(b=F.col("value") > 50).alias("value")),
        F.struct(F.lit("ctx").alias("key"), val(kv=ctx).alias("value")))


@query("otlp_value_kinds", """
WITH e AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS trace_id, event_type, user_id, value,
                  json_extract_string(props, '$.k') AS k FROM events)
SELECT trace_id, 0 AS pos, 'event.type' AS key, event_type AS value FROM e
UNION ALL SELECT trace_id, 1, 'k', k FROM e
UNION ALL SELECT trace_id, 2, 'value', regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') FROM e
UNION ALL SELECT trace_id, 3, 'big', CASE WHEN value > 50 THEN 'true' ELSE 'false' END FROM e
UNION ALL SELECT trace_id, 4, 'ctx', '{"type":"' || event_type || '","user":' || CAST(user_id AS VARCHAR) || '}' FROM e""")
def q_otlp_value_kinds(spark, sf_dir):
    ev = _events(payload_session(spark), sf_dir).withColumn("log_attributes", _typed_attributes())
    logs = logs_from_events(ev, keep=("log_attributes",)).withColumn("batch_id", F.expr(f"event_id div {BATCH}"))
    b = F.col("batch_id")
    ct = F.when(b % 2 == 0, F.lit("application/json")).otherwise(F.lit("application/x-protobuf"))
    enc = F.element_at(F.array(F.lit(""), F.lit("zstd"), F.lit("gzip")), (b % 3 + 1).cast("int"))
    env = E.to_envelopes(E.otlp_export(logs, "batch_id"), ct, enc)
    flat, _ = E.envelopes_to_logs(env)
    z = flat.select("trace_id", F.posexplode(F.arrays_zip("log_attr_keys", "log_attr_values")).alias("pos", "kv"))
    return z.select("trace_id", F.col("pos").cast("int").alias("pos"),
                    F.col("kv.log_attr_keys").alias("key"), F.col("kv.log_attr_values").alias("value"))
