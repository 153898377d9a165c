"""OTLP decode and flatten (P3, P5-P9, P11, P12) as one Spark job.

Envelopes in, flat log rows (plus quarantine rows) out:

1. content-type routing (P5): JSON text is parsed by ``from_json`` with a
   fixed schema; protobuf is read into typed columns of the same schema in an
   Arrow UDF (``otlp_proto``);
2. undecodable payloads get an error column instead of failing the job (P6);
3. three nested ``explode`` (resourceLogs -> scopeLogs -> logRecords), not
   ``explode_outer``: an empty list yields no rows (P7);
4. every field mapping is a column expression (P8-P12).

Nothing here shuffles; the decode runs where the envelope partitions are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logpond import schema as S
from logpond.functions import values as V
from logpond.sources import codecs

_KVS = T.ArrayType(V.KEY_VALUE_TYPE)

LOG_RECORD_TYPE = T.StructType([
    T.StructField("timeUnixNano", T.StringType()),
    T.StructField("observedTimeUnixNano", T.StringType()),
    T.StructField("severityNumber", T.StringType()),
    T.StructField("severityText", T.StringType()),
    T.StructField("body", V.ANY_VALUE_TYPE),
    T.StructField("attributes", _KVS),
    T.StructField("traceId", T.StringType()),
    T.StructField("spanId", T.StringType()),
    T.StructField("flags", T.StringType()),
    T.StructField("eventName", T.StringType()),
])
SCOPE_LOGS_TYPE = T.StructType([
    T.StructField("scope", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("attributes", _KVS),
    ])),
    T.StructField("logRecords", T.ArrayType(LOG_RECORD_TYPE)),
    T.StructField("schemaUrl", T.StringType()),
])
RESOURCE_LOGS_TYPE = T.StructType([
    T.StructField("resource", T.StructType([T.StructField("attributes", _KVS)])),
    T.StructField("scopeLogs", T.ArrayType(SCOPE_LOGS_TYPE)),
    T.StructField("schemaUrl", T.StringType()),
])
CORRUPT = "_corrupt_record"
REQUEST_TYPE = T.StructType([
    T.StructField("resourceLogs", T.ArrayType(RESOURCE_LOGS_TYPE)),
    T.StructField(CORRUPT, T.StringType()),
])
JSON_OPTIONS = {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}

# OTLP severity enum names, four numbers per level from the base.
SEVERITY_ENUM_BASE = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}


def severity_number_from(text: Column) -> Column:
    """Number or enum name (``SEVERITY_NUMBER_WARN3``) -> int; else 0."""
    t = F.trim(text)
    m = F.regexp_extract(t, r"^SEVERITY_NUMBER_([A-Z]+?)([234]?)$", 1)
    suffix = F.regexp_extract(t, r"^SEVERITY_NUMBER_([A-Z]+?)([234]?)$", 2)
    base = F.lit(None).cast("int")
    for name, num in SEVERITY_ENUM_BASE.items():
        base = F.when(m == name, F.lit(num)).otherwise(base)
    offset = F.when(suffix == "", F.lit(0)).otherwise(suffix.try_cast("int") - 1)
    n = F.coalesce(t.try_cast("int"), base + offset, F.lit(0))
    return F.pmod(n, F.lit(256)).cast("int")   # stored as an unsigned byte


def _all_ids(parsed: Column, field: str) -> Column:
    # resourceLogs[].scopeLogs[].logRecords[].<id>, one level at a time:
    # field extraction over array<struct> plus flatten, no lambdas
    scopes = F.flatten(parsed.getField("resourceLogs").getField("scopeLogs"))
    records = F.flatten(scopes.getField("logRecords"))
    return records.getField(field)


def ids_valid(parsed: Column) -> Column:
    """Every trace id is empty or 32 hex digits and every span id empty or
    16 (a payload with any other id is rejected whole, as the OTLP decoder
    does). Searched for over the joined ids, without a lambda per id: a
    character that is no hex digit, then an id that is too short or too
    long. Neither pattern repeats a group, so the number of records does
    not matter to the regex engine."""
    def ok(field, n):
        joined = F.array_join(_all_ids(parsed, field), ",", "")
        bad_length = f"(?:^|,)(?:[^,]{{1,{n - 1}}}+(?=,|$)|[^,]{{{n + 1}}})"
        bad = joined.rlike("[^0-9a-fA-F,]") | joined.rlike(bad_length)
        commas = F.char_length(joined) - F.char_length(F.replace(joined, F.lit(","), F.lit("")))
        own = commas > F.greatest(F.size(_all_ids(parsed, field)) - 1, F.lit(0))      # a comma inside an id
        return ~F.coalesce(bad | own, F.lit(False))
    return ok("traceId", 32) & ok("spanId", 16)


def decode_requests(env: DataFrame, payload: str = "payload", content_type: str = "content_type",
                    content_encoding: str | None = "content_encoding", on_payload=None) -> DataFrame:
    """P1 + P3-P5: decompress and parse; adds ``request`` (parsed struct)
    and ``decode_error``.

    One Arrow round trip (``codecs.payload_codec``) decompresses, decodes
    protobuf into typed columns and gives nested JSON values their text. Plain
    JSON without nested values is parsed from its original bytes and never
    handed to Python; the texts of its scalar values are JVM expressions.
    Errors follow the worker's order: encoding, decompression, content
    type, protobuf, parse."""
    ct = F.coalesce(F.col(content_type), F.lit(""))
    enc = F.coalesce(F.col(content_encoding), F.lit("")) if content_encoding else F.lit("")
    is_json = ct.startswith("application/json")
    is_proto = ct.startswith("application/x-protobuf")
    passthrough = enc.isin(*S.PASSTHROUGH_ENCODINGS)
    compressed = enc.isin("gzip", "zstd")
    p = F.col(payload)
    nested = F.lit(False)
    for key in codecs.NESTED_KEYS:
        nested = nested | F.contains(p, F.lit(key))
    needs_py = (compressed & (is_json | is_proto)) | (passthrough & (is_proto | (is_json & nested)))
    request_type = REQUEST_TYPE["resourceLogs"].dataType
    df = env.withColumn("_codec", codecs.payload_codec(F.when(needs_py, p), enc, is_proto, request_type, on_payload))
    plain = F.coalesce(F.col("_codec.payload"), F.when(passthrough, p))
    text = F.coalesce(F.col("_codec.json"), F.when(is_json, plain.cast("string")))
    # two projections: CollapseProject does not inline a non-trivial
    # expression that is used twice, so from_json runs once per payload
    df = df.withColumn("_parsed", F.from_json(text, REQUEST_TYPE, JSON_OPTIONS))
    df = df.withColumn("_ids_ok", ids_valid(F.col("_parsed")))
    typed = F.col("_codec.request")
    df = df.withColumn("request", F.when(typed.isNotNull(), F.struct(
        typed.alias("resourceLogs"), F.lit(None).cast("string").alias(CORRUPT)))
        .when(F.col("_ids_ok"), F.col("_parsed")))
    err = (F.when(~passthrough & ~compressed, F.lit("unsupported encoding"))
           .when(~is_json & ~is_proto, F.concat(F.lit("unsupported or missing content type: "), ct))
           .when(F.col("_codec.error").isNotNull(), F.col("_codec.error"))
           .when(p.isNull(), F.lit("empty payload"))
           .when(typed.isNull() & (F.col("_parsed").isNull() | F.col(f"_parsed.{CORRUPT}").isNotNull()),
                 F.lit("invalid json payload"))
           .when(typed.isNull() & ~F.col("_ids_ok"), F.lit("invalid trace or span id")))
    return df.withColumn("decode_error", err).drop("_codec", "_parsed", "_ids_ok")


def _keys(attrs: Column) -> Column:
    # field extraction over an array of structs is codegen'd
    return F.coalesce(attrs["key"], F.array().cast(T.ArrayType(T.StringType())))


def _texts(attrs: Column) -> Column:
    """Value texts of an attribute list. A list of strings, as most are, is
    field extraction; one with a missing value or another scalar kind takes
    the per-element path (nested kinds became texts in ``decode_requests``)."""
    strings = attrs["value"]["stringValue"]
    all_strings = F.array_contains(strings, F.lit("\u0001")).isNotNull()
    return (F.when(attrs.isNull(), F.array().cast(T.ArrayType(T.StringType())))
            .when(all_strings, strings)
            .otherwise(F.transform(attrs, lambda a: F.coalesce(V.scalar_value_text(a["value"]), F.lit("")))))


QUARANTINE_COLUMNS = (("payload", T.BinaryType()), ("content_type", T.StringType()),
                      ("content_encoding", T.StringType()), ("error", T.StringType()))


def flatten_all(decoded: DataFrame, batch_nanos: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """P6 + P7 in one pass: the rows of ``flatten`` with null
    ``QUARANTINE_COLUMNS``, and one row per payload that could not be decoded
    with these columns filled and no record in the others."""
    bad = F.col("decode_error").isNotNull()
    marked = decoded.withColumn("error", F.col("decode_error"))
    for name, _ in QUARANTINE_COLUMNS[:-1]:
        marked = marked.withColumn(name, F.when(bad, F.col(name)))
    return flatten(marked, batch_nanos, (*keep, *[n for n, _ in QUARANTINE_COLUMNS]), "error")


def flatten(decoded: DataFrame, batch_nanos: Column | None = None, keep: tuple[str, ...] = (),
            error: str | None = None) -> DataFrame:
    """One row per (resource, scope, record), resource and scope fields
    repeated. ``batch_nanos`` replaces missing times (P9); default is the
    query's current time. ``keep`` names input columns carried along;
    ``error`` one of them that keeps a row without records where it is set
    (see ``flatten_all``)."""
    explode = F.explode if error is None else F.explode_outer
    record = F.col("r").isNotNull()

    def held(c: str) -> Column:
        return F.col(c).isNotNull() if error is None else F.col(c).isNotNull() | F.col(error).isNotNull()

    if batch_nanos is None:
        batch_nanos = F.unix_micros(F.current_timestamp()) * 1000
    # No filter on decode_error: a payload that failed anywhere has a NULL
    # request (or only the corrupt-record field set), so it yields no rows.
    # Any filter below this point (ours, or the size(..) > 0 filter Spark
    # infers for an inner explode) would be pushed under the projection and
    # make Spark evaluate from_json and the codec UDF more than once per
    # payload; explode_outer infers none, and the NULL rows it emits for
    # empty or missing lists are dropped on the generated column instead.
    rl = (decoded.select(*keep, batch_nanos.alias("_batch_nanos"),
                         F.explode_outer(F.col("request.resourceLogs")).alias("rl"))
          .filter(held("rl")))
    res_attrs = F.col("rl.resource.attributes")
    rl = rl.select(*keep, "_batch_nanos",
                   _keys(res_attrs).alias("res_attr_keys"),
                   _texts(res_attrs).alias("res_attr_values"),
                   explode("rl.scopeLogs").alias("sl"))
    rl = rl.withColumn("service_name", V.service_name_from("res_attr_keys", "res_attr_values"))
    recs = rl.select(*keep, "_batch_nanos", "res_attr_keys", "res_attr_values", "service_name",
                     F.coalesce(F.col("sl.scope.name"), F.lit("")).alias("scope_name"),
                     F.coalesce(F.col("sl.scope.version"), F.lit("")).alias("scope_version"),
                     explode("sl.logRecords").alias("r"))
    if error is not None:
        recs = recs.filter(held("r"))
    ts_nanos = V.default_time_nanos(F.col("r.timeUnixNano").try_cast("bigint"), F.col("_batch_nanos"))
    obs_nanos = V.default_time_nanos(F.col("r.observedTimeUnixNano").try_cast("bigint"), F.col("_batch_nanos"))
    if error is not None:
        recs = recs.withColumn("_batch_nanos", F.when(record, F.col("_batch_nanos")))
    out = recs.select(
        *keep,
        V.nanos_to_ts(ts_nanos).alias("ts"),
        ts_nanos.alias("ts_nanos"),
        V.nanos_to_ts(obs_nanos).alias("observed_ts"),
        obs_nanos.alias("observed_ts_nanos"),
        F.lit(None).cast("timestamp").alias("inserted_at"),
        V.id_text(F.col("r.traceId"), 16).alias("trace_id"),
        V.id_text(F.col("r.spanId"), 8).alias("span_id"),
        F.coalesce(F.col("r.severityText"), F.lit("")).alias("severity_text"),
        severity_number_from(F.col("r.severityNumber")).alias("severity_number"),
        "service_name",
        F.coalesce(F.col("r.body.stringValue"), V.scalar_value_text(F.col("r.body")), F.lit("")).alias("body"),
        F.lit(S.BODY_TYPE_STRING).alias("body_type"),
        "scope_name", "scope_version",
        _keys(F.col("r.attributes")).alias("log_attr_keys"),
        _texts(F.col("r.attributes")).alias("log_attr_values"),
        "res_attr_keys", "res_attr_values",
    )
    return out.withColumn("log_date", F.to_date("ts"))


def quarantine(decoded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows that could not be decoded, kept with their reason (the
    service drops them; here they are written aside instead of lost)."""
    return decoded.filter(F.col("decode_error").isNotNull()).select(
        *keep, "payload", "content_type", "content_encoding", F.col("decode_error").alias("error"))
