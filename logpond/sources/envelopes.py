"""Envelopes: admission (S3), decompression + decode (P1-P6) and the OTLP
export encoder (S12).

An envelope is one stored request: ``payload`` bytes plus the
``content_type`` / ``content_encoding`` headers, ``num_delivered`` and
``received_at``. Batch sources are parquet / binaryFile tables; the stream
source is a ``readStream`` over the same layout (``streaming.ingest``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logpond import schema as S
from logpond.sources import codecs
from logpond.sources.otlp_json import decode_requests, flatten, quarantine
from logpond.sources.otlp_proto import json_text_to_proto


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Stored envelopes (parquet with the ``ENVELOPE_SCHEMA`` columns)."""
    return spark.read.schema(S.ENVELOPE_SCHEMA).parquet(path)


def read_raw_payloads(spark: SparkSession, path: str, content_type: str,
                      content_encoding: str = "") -> DataFrame:
    """S1 variant: one file per payload (``binaryFile``); headers given."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(
        F.xxhash64("path").alias("batch_id"),
        F.col("content").alias("payload"),
        F.lit(content_type).alias("content_type"),
        F.lit(content_encoding).alias("content_encoding"),
        F.lit(1).alias("num_delivered"),
        F.col("modificationTime").cast("timestamp").alias("received_at"))


def admission(content_type="content_type", content_encoding="content_encoding") -> tuple[Column, Column]:
    """S3 as columns: (accepted, reject_reason)."""
    ct = F.coalesce(F.col(content_type), F.lit(""))
    enc = F.coalesce(F.col(content_encoding), F.lit(""))
    type_ok = F.lit(False)
    for t in S.ACCEPTED_CONTENT_TYPES:
        type_ok = type_ok | ct.startswith(t)
    enc_ok = enc.isin(*S.ACCEPTED_ENCODINGS)
    reason = (F.when(~type_ok, F.concat(F.lit("Unsupported or Missing Content-Type: "), ct))
              .when(~enc_ok, F.concat(F.lit("Unsupported Content-Encoding: "), enc)))
    return (type_ok & enc_ok), reason


def admit_envelopes(env: DataFrame) -> DataFrame:
    """S3: every envelope with ``accepted`` and ``reject_reason``; split with
    ``filter('accepted')`` / ``filter('NOT accepted')``."""
    accepted, reason = admission()
    return env.withColumn("accepted", accepted).withColumn("reject_reason", reason)


def decompress_envelopes(env: DataFrame) -> DataFrame:
    """Payload replaced by its decompressed bytes; ``decompress_error``
    set for unsupported encodings and corrupt data."""
    d = codecs.decompress("payload", "content_encoding")
    return (env.withColumn("_d", d)
            .withColumn("decompress_error", F.col("_d.error"))
            .withColumn("payload", F.col("_d.payload"))
            .drop("_d"))


def decode_envelopes(env: DataFrame) -> DataFrame:
    """P1 + P3-P6: decompress and parse; ``decode_error`` carries the first
    failure (encoding, decompression, content type or decode)."""
    return decode_requests(env)


def envelopes_to_logs(env: DataFrame, batch_nanos: Column | None = None,
                      keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Full decode job: (flat log rows, quarantine rows)."""
    decoded = decode_envelopes(env)
    return flatten(decoded, batch_nanos, keep), quarantine(decoded, keep)


# ---------------------------------------------------------------------------
# Encoder (log rows -> OTLP/JSON requests -> envelopes)
# ---------------------------------------------------------------------------
def _kv_list(keys: str, values: str) -> Column:
    return F.transform(F.col(keys), lambda k, i: F.struct(
        k.alias("key"), F.struct(F.get(F.col(values), i).alias("stringValue")).alias("value")))


def otlp_export(logs: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """Group log rows into OTLP/JSON export requests, one per batch.
    Attributes come from the key/value text arrays, or from a
    ``log_attributes`` column (list of key + AnyValue struct) when present:
    (batch, resource, scope) -> scopeLogs, (batch, resource) -> resourceLogs.

    The rows are shuffled once, on the batch column; the three grouping
    levels all reuse that partitioning. Group sizes are bounded by the batch
    size, so no task collects more than one batch of records at a time.
    """
    rec = F.struct(
        F.col("ts_nanos").cast("string").alias("timeUnixNano"),
        F.col("observed_ts_nanos").cast("string").alias("observedTimeUnixNano"),
        F.col("severity_number").alias("severityNumber"),
        F.col("severity_text").alias("severityText"),
        F.struct(F.col("body").alias("stringValue")).alias("body"),
        (F.col("log_attributes") if "log_attributes" in logs.columns
         else _kv_list("log_attr_keys", "log_attr_values")).alias("attributes"),
        F.col("trace_id").alias("traceId"),
        F.col("span_id").alias("spanId"),
    )
    rows = logs.repartition(batch_col).select(
        batch_col, "res_attr_keys", "res_attr_values", "scope_name", "scope_version", rec.alias("rec"))
    scopes = (rows.groupBy(batch_col, "res_attr_keys", "res_attr_values", "scope_name", "scope_version")
              .agg(F.array_sort(F.collect_list("rec")).alias("recs"))
              .select(batch_col, "res_attr_keys", "res_attr_values",
                      F.struct(F.struct(F.col("scope_name").alias("name"), F.col("scope_version").alias("version")).alias("scope"),
                               F.col("recs").alias("logRecords")).alias("sl")))
    resources = (scopes.groupBy(batch_col, "res_attr_keys", "res_attr_values")
                 .agg(F.array_sort(F.collect_list("sl")).alias("sls"))
                 .select(batch_col, F.struct(
                     F.struct(_kv_list("res_attr_keys", "res_attr_values").alias("attributes")).alias("resource"),
                     F.col("sls").alias("scopeLogs")).alias("rl")))
    reqs = resources.groupBy(batch_col).agg(F.array_sort(F.collect_list("rl")).alias("rls"))
    return reqs.select(batch_col, F.to_json(F.struct(F.col("rls").alias("resourceLogs"))).alias("json"))


def to_envelopes(requests: DataFrame, content_type: Column, content_encoding: Column,
                 json_col: str = "json", received_at: Column | None = None) -> DataFrame:
    """Wrap OTLP/JSON requests as envelopes: protobuf content types get the
    binary encoding, then the payload is compressed per encoding."""
    ct = F.coalesce(content_type, F.lit(""))
    df = requests.withColumn("content_type", content_type).withColumn("content_encoding", content_encoding)
    is_proto = ct.startswith("application/x-protobuf")
    raw = F.when(is_proto, json_text_to_proto(F.when(is_proto, F.col(json_col)))) \
        .otherwise(F.encode(F.col(json_col), "UTF-8"))
    df = df.withColumn("payload", raw)
    df = df.withColumn("payload", codecs.compress("payload", "content_encoding"))
    return df.select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "payload",
        "content_type", "content_encoding",
        F.lit(1).alias("num_delivered"),
        (received_at if received_at is not None else F.current_timestamp()).alias("received_at"))
