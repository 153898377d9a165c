import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from logpond.sources import codecs
from logpond.sources.envelopes import admit_envelopes, decompress_envelopes, envelopes_to_logs
from logpond.sources.otlp_proto import json_to_proto, proto_to_dict
from logpond.functions.values import any_value_text_py, float_text

ENV_DDL = ("batch_id bigint, payload binary, content_type string, content_encoding string, "
           "num_delivered int, received_at timestamp")
NOW_NS = 1717732530000000000


def kv(k, v):
    return {"key": k, "value": v}


def s(v):
    return {"stringValue": v}


def record(**kw):
    r = {"timeUnixNano": str(NOW_NS), "observedTimeUnixNano": str(NOW_NS), "severityNumber": 9,
         "severityText": "INFO", "body": s("User logged in successfully"),
         "traceId": "5b8efff798038103d269b633813fc60c", "spanId": "eee19b7ec3c1b174"}
    r.update(kw)
    return r


def request(*resources):
    return {"resourceLogs": list(resources)}


def resource(attrs, *scopes):
    return {"resource": {"attributes": attrs}, "scopeLogs": list(scopes)}


def scope(*records, name="auth", version="1.0"):
    return {"scope": {"name": name, "version": version}, "logRecords": list(records)}


def env_df(spark, payloads):
    rows = []
    for i, (payload, ct, enc) in enumerate(payloads):
        rows.append((i, payload, ct, enc, 1, None))
    return spark.createDataFrame(rows, ENV_DDL)


def flat(spark, req, ct="application/json", enc="", batch_ns=NOW_NS + 5):
    text = json.dumps(req)
    if ct.startswith("application/x-protobuf"):
        data = json_to_proto(text)
    else:
        data = text.encode()
    data = codecs.compress_bytes(data, enc)
    logs, bad = envelopes_to_logs(env_df(spark, [(data, ct, enc)]), F.lit(batch_ns))
    return logs.orderBy("ts_nanos", "trace_id").collect(), bad.collect()


@pytest.mark.parametrize("ct", ["application/json", "application/x-protobuf"])
def test_single_log(spark, ct):
    rows, bad = flat(spark, request(resource([kv("service.name", s("auth-service"))], scope(record()))), ct)
    assert len(rows) == 1 and not bad
    r = rows[0]
    assert r["ts_nanos"] == NOW_NS
    assert r["ts"] == dt.datetime(2024, 6, 7, 3, 55, 30) or r["ts"].replace(tzinfo=None) == dt.datetime(2024, 6, 7, 3, 55, 30)
    assert r["service_name"] == "auth-service"
    assert r["severity_text"] == "INFO" and r["severity_number"] == 9
    assert r["body"] == "User logged in successfully" and r["body_type"] == "string"
    assert r["trace_id"] == "5b8efff798038103d269b633813fc60c" and r["span_id"] == "eee19b7ec3c1b174"
    assert r["res_attr_keys"] == ["service.name"] and r["res_attr_values"] == ["auth-service"]


def test_attributes_kept_in_order_with_duplicates(spark):
    rec = record(attributes=[kv("user.id", s("12345")), kv("a", s("1")), kv("a", s("2"))])
    rows, _ = flat(spark, request(resource([kv("service.name", s("auth")), kv("host", s("h1"))], scope(rec))))
    assert rows[0]["log_attr_keys"] == ["user.id", "a", "a"]
    assert rows[0]["log_attr_values"] == ["12345", "1", "2"]
    assert rows[0]["res_attr_keys"] == ["service.name", "host"]


def test_two_resources_two_records(spark):
    req = request(resource([kv("service.name", s("a"))], scope(record(), record(spanId="eee19b7ec3c1b175"))),
                  resource([kv("service.name", s("b"))], scope(record())))
    rows, _ = flat(spark, req)
    assert sorted(r["service_name"] for r in rows) == ["a", "a", "b"]


@pytest.mark.parametrize("attrs,expected", [
    ([], "unknown"),
    ([kv("service.name", s(""))], "unknown"),
    ([kv("service.name", s("first")), kv("service.name", s("second"))], "second"),
    ([kv("service.name", s("first")), kv("service.name", s(""))], "first"),
])
def test_service_name_rule(spark, attrs, expected):
    rows, _ = flat(spark, request(resource(attrs, scope(record()))))
    assert rows[0]["service_name"] == expected


def test_missing_times_use_batch_clock(spark):
    rec = record()
    del rec["timeUnixNano"]
    rec["observedTimeUnixNano"] = "0"
    rows, _ = flat(spark, request(resource([], scope(rec))), batch_ns=NOW_NS + 7000)
    assert rows[0]["ts_nanos"] == NOW_NS + 7000
    assert rows[0]["observed_ts"] == rows[0]["ts"]


@pytest.mark.parametrize("req", [request(), request(resource([], scope())), request(resource([]))])
def test_empty_lists_give_no_rows(spark, req):
    rows, bad = flat(spark, req)
    assert rows == [] and bad == []


def test_several_scopes(spark):
    req = request(resource([], scope(record(), name="s1"), scope(record(), name="s2", version="")))
    rows, _ = flat(spark, req)
    assert sorted((r["scope_name"], r["scope_version"]) for r in rows) == [("s1", "1.0"), ("s2", "")]


@pytest.mark.parametrize("ct,enc", [("application/json", ""), ("application/json", "gzip"),
                                    ("application/x-protobuf", "zstd"), ("application/x-protobuf", "")])
def test_value_kinds_become_text(spark, ct, enc):
    attrs = [kv("i", {"intValue": "42"}), kv("d", {"doubleValue": 2.5}), kv("b", {"boolValue": True}),
             kv("by", {"bytesValue": "aGk="}), kv("arr", {"arrayValue": {"values": [s("x"), {"intValue": "1"}]}}),
             kv("kv", {"kvlistValue": {"values": [kv("z", s("<&>")), kv("a", {"doubleValue": 100.0})]}}),
             kv("e", {}), kv("big", {"doubleValue": 1e21}), kv("tiny", {"doubleValue": 1.5e-7})]
    rows, _ = flat(spark, request(resource([], scope(record(attributes=attrs, body={"intValue": "7"})))), ct, enc)
    r = rows[0]
    assert r["body"] == "7"
    assert dict(zip(r["log_attr_keys"], r["log_attr_values"])) == {
        "i": "42", "d": "2.5", "b": "true", "by": "aGk=", "arr": '["x",1]',
        "kv": '{"a":100,"z":"\\u003c\\u0026\\u003e"}', "e": "", "big": "1e+21", "tiny": "1.5e-7"}


def test_severity_enum_names(spark):
    recs = [record(severityNumber="SEVERITY_NUMBER_WARN3", spanId="a" * 16),
            record(severityNumber="SEVERITY_NUMBER_FATAL", spanId="b" * 16)]
    rows, _ = flat(spark, request(resource([], scope(*recs))))
    assert sorted(r["severity_number"] for r in rows) == [15, 21]


def test_empty_ids_become_zeros(spark):
    rows, _ = flat(spark, request(resource([], scope(record(traceId="", spanId="")))))
    assert rows[0]["trace_id"] == "0" * 32 and rows[0]["span_id"] == "0" * 16


def test_decode_cases_and_mixed_batch(spark):
    good = json.dumps(request(resource([], scope(record())))).encode()
    proto = json_to_proto(good.decode())
    cases = [(good, "application/json", ""),            # valid json
             (b'{"resourceLogs": [', "application/json", ""),  # invalid json
             (good, "text/plain", ""),                   # wrong header
             (good, None, ""),                           # no header
             (proto, "application/x-protobuf", ""),      # valid protobuf
             (b"\x0a\xff\xff", "application/x-protobuf", ""),  # invalid protobuf
             (good, "application/json", "br"),           # unsupported encoding
             (b"not gzip", "application/json", "gzip")]  # corrupt gzip
    logs, bad = envelopes_to_logs(env_df(spark, cases), F.lit(NOW_NS), keep=("batch_id",))
    assert sorted(r["batch_id"] for r in logs.select("batch_id").collect()) == [0, 4]
    errs = {r["batch_id"]: r["error"] for r in bad.collect()}
    assert sorted(errs) == [1, 2, 3, 5, 6, 7]
    assert errs[1] == "invalid json payload"
    assert errs[2].startswith("unsupported or missing content type: text/plain")
    assert errs[3] == "unsupported or missing content type: "
    assert errs[5].startswith("protobuf decode error")
    assert errs[6] == "unsupported encoding"
    assert errs[7].startswith("gzip decompress error")


def test_decompress_cases(spark):
    raw = b'{"resourceLogs": []}'
    cases = [(codecs.compress_bytes(raw, "zstd"), "application/json", "zstd"),
             (gzip.compress(raw), "application/json", "gzip"),
             (raw, "application/json", "br"),
             (raw, "application/json", "deflate"),
             (raw, "application/json", None),
             (raw, "application/json", ""),
             (raw, "application/json", "none")]
    out = decompress_envelopes(env_df(spark, cases)).orderBy("batch_id").collect()
    assert [bytes(r["payload"]) for r in out[:2]] == [raw, raw]
    assert [r["decompress_error"] for r in out[2:4]] == ["unsupported encoding"] * 2
    assert all(bytes(r["payload"]) == raw and r["decompress_error"] is None for r in out[4:])


def test_sniff(spark):
    raw = b'{"a": 1}'
    df = env_df(spark, [(codecs.compress_bytes(raw, "zstd"), "x", ""), (gzip.compress(raw), "x", ""), (raw, "x", "")])
    got = [r["c"] for r in df.orderBy("batch_id").select(codecs.sniff_compression("payload").alias("c")).collect()]
    assert got == ["zstd", "gzip", "none"]


def test_admission(spark):
    df = env_df(spark, [(b"", "application/json", ""), (b"", "application/x-protobuf; x=1", "zstd"),
                        (b"", "text/plain", ""), (b"", None, ""), (b"", "application/json", "none"),
                        (b"", "application/json", "br")])
    got = [r["accepted"] for r in admit_envelopes(df).orderBy("batch_id").collect()]
    assert got == [True, True, False, False, False, False]


def test_proto_roundtrip_ids_hex():
    req = request(resource([kv("service.name", s("x"))], scope(record())))
    back = proto_to_dict(json_to_proto(json.dumps(req)))
    rec = back["resourceLogs"][0]["scopeLogs"][0]["logRecords"][0]
    assert rec["traceId"] == "5b8efff798038103d269b633813fc60c"
    assert rec["timeUnixNano"] == str(NOW_NS)


@pytest.mark.parametrize("v,text", [(100.0, "100"), (6.55, "6.55"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"),
                                    (-0.0, "-0"), (123456789.125, "123456789.125")])
def test_float_text(v, text):
    assert float_text(v) == text


def test_any_value_text_py():
    assert any_value_text_py({"kvlistValue": {"values": [kv("b", {"boolValue": False}), kv("a", s("x"))]}}) \
        == '{"a":"x","b":false}'
    assert any_value_text_py({}) == ""


@pytest.mark.parametrize("ct", ["application/json", "application/x-protobuf"])
def test_bad_ids_reject_the_payload(spark, ct):
    if ct.startswith("application/x-protobuf"):
        from logpond.sources.otlp_proto import _request_class
        m = _request_class()()
        rec = m.resource_logs.add().scope_logs.add().log_records.add()
        rec.trace_id = b"\x01" * 15
        data = m.SerializeToString()
    else:
        data = json.dumps(request(resource([], scope(record(), record(traceId="xyz"))))).encode()
    logs, bad = envelopes_to_logs(env_df(spark, [(data, ct, "")]), F.lit(NOW_NS))
    assert logs.count() == 0
    err = bad.first()["error"]
    assert "invalid trace or span id" in err


def test_uppercase_ids_and_byte_severity(spark):
    rows, _ = flat(spark, request(resource([], scope(record(traceId="5B8EFFF798038103D269B633813FC60C",
                                                            severityNumber=257)))))
    assert rows[0]["trace_id"] == "5b8efff798038103d269b633813fc60c"
    assert rows[0]["severity_number"] == 1


@pytest.mark.parametrize("ct,enc,accepted", [
    ("application/json", None, True), ("application/json", "gzip", True), ("application/json", "zstd", True),
    ("application/x-protobuf", None, True), ("application/x-protobuf", "gzip", True),
    ("application/x-protobuf", "zstd", True), ("text/plain", None, False), (None, None, False),
    ("application/json", "deflate", False), ("application/x-protobuf", "br", False),
    ("application/json", "identity", True), ("application/json", "none", False),
])
def test_admission_matrix(spark, ct, enc, accepted):
    df = env_df(spark, [(b"{}", ct, enc)])
    r = admit_envelopes(df).first()
    assert r["accepted"] is accepted
    assert (r["reject_reason"] is None) is accepted


@pytest.mark.parametrize("ct,enc", [("application/json", ""), ("application/json", "gzip"),
                                    ("application/json", "zstd"), ("application/x-protobuf", ""),
                                    ("application/x-protobuf", "gzip"), ("application/x-protobuf", "zstd")])
def test_accepted_envelopes_decode(spark, ct, enc):
    rows, bad = flat(spark, request(resource([kv("service.name", s("svc"))], scope(record(), record(spanId="1" * 16)))),
                     ct, enc)
    assert len(rows) == 2 and bad == []


def test_attrs_values_text_standalone(spark):
    from logpond.functions.values import KEY_VALUE_TYPE, attrs_keys, attrs_values_text
    from pyspark.sql import types as T
    data = [([{"key": "a", "value": {"stringValue": "x"}}, {"key": "b", "value": {"intValue": "5"}},
              {"key": "c", "value": {"kvlistValue": '{"values":[{"key":"z","value":{"boolValue":true}}]}'}}],),
            ([{"key": "s", "value": {"stringValue": "only"}}],), (None,)]
    df = spark.createDataFrame(data, T.StructType([T.StructField("attrs", T.ArrayType(KEY_VALUE_TYPE))]))
    got = [(r["k"], r["v"]) for r in df.select(attrs_keys("attrs").alias("k"), attrs_values_text("attrs").alias("v")).collect()]
    assert got == [(["a", "b", "c"], ["x", "5", '{"z":true}']), (["s"], ["only"]), ([], [])]


@pytest.mark.parametrize("ct", ["application/json", "application/x-protobuf"])
def test_fifty_thousand_records_in_one_request(spark, ct):
    n = 50_000
    recs = [record(traceId=f"{i:032x}", spanId=f"{i:016x}" if i % 2 else "") for i in range(n)]
    rows, bad = flat(spark, request(resource([kv("service.name", s("a"))], scope(*recs))), ct)
    assert not bad and len(rows) == n and len({r["trace_id"] for r in rows}) == n


@pytest.mark.parametrize("ids", [("0" * 31, ""), ("0" * 33, ""), ("", "0" * 15), ("", "0" * 32), ("g" + "0" * 31, ""),
                                 ("0" * 15 + "," + "0" * 16, ""), ("", ","), (",", "")])
def test_one_bad_id_among_many(spark, ids):
    recs = [record(), record(traceId="", spanId="")] * 50
    recs.insert(40, record(traceId=ids[0], spanId=ids[1]))
    rows, bad = flat(spark, request(resource([], scope(*recs))))
    assert not rows and [b["error"] for b in bad] == ["invalid trace or span id"]


def test_all_frames_are_read():
    parts = [b"one" * 1000, b"", b"two", b"three" * 9]
    for enc in ("gzip", "zstd"):
        data = b"".join(codecs.compress_bytes(p, enc) for p in parts)
        assert codecs.decompress_bytes(data, enc) == b"".join(parts)
        with pytest.raises(Exception):
            codecs.decompress_bytes(data[:-3], enc)
    with pytest.raises(Exception):
        codecs.decompress_bytes(codecs.compress_bytes(b"x", "zstd") + b"tail", "zstd")


@pytest.mark.parametrize("name", ["quarantine_split", "decompress_payloads", "otlp_flatten_proto", "otlp_flatten_large",
                                  "otlp_value_kinds", "attr_arrays", "otlp_flatten", "sniff_compression"])
def test_payload_queries_have_small_arrow_batches(spark, name):
    """The bytes that a Python worker holds do not grow
    with the table; the caller's session keeps its own batches."""
    from logpond.plans import registry
    registry.load_all()
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    own = registry.QUERIES[name](spark, "/root/testdata/sf0.001").sparkSession
    assert int(own.conf.get(key)) <= 1 << 20
    assert int(own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 64
    assert spark.conf.get(key, None) == before


def test_payload_session_bounds_batches_and_keeps_settings(spark):
    """F3, F5, F6 too: the ingest's envelopes are made in such a session."""
    from logpond.plans.q_stream import _envelopes
    from logpond.session import payload_session

    @F.pandas_udf("long")
    def batch_bytes(text):
        size = text.str.len()
        return size * 0 + int(size.sum())

    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        own = payload_session(spark)
        assert own.conf.get("spark.sql.shuffle.partitions") == "3"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    big = own.range(200, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    assert big.select(F.max(batch_bytes("t"))).first()[0] <= 2 << 20
    small = own.range(500, numPartitions=1).select(F.lit("x").alias("t"))
    assert small.select(F.max(batch_bytes("t"))).first()[0] <= 64
    made = _envelopes(spark, "/root/testdata/sf0.001").sparkSession
    assert int(made.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 20
