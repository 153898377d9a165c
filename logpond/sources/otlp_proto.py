"""OTLP/protobuf codec (P4) for the decode job.

The spark-protobuf module is not on the classpath, so protobuf payloads are
read inside the decode job's single codec UDF (``sources.codecs.payload_codec``)
into typed Arrow columns of the schema that JSON payloads are parsed to, and
then go through the same flatten: Python only does the wire format, every
relational step stays in the JVM.

The message descriptors are declared here in code, following the public
OpenTelemetry protocol definitions (logs v1, common v1, resource v1).
"""

from __future__ import annotations

import base64
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:  # gated: protobuf runtime is optional
    from google.protobuf import descriptor_pb2, descriptor_pool, json_format, message_factory
except ImportError:  # pragma: no cover
    descriptor_pb2 = None

_PKG = "otlp.logs"
_F = None  # FieldDescriptorProto, set lazily

# (message, [(field name, number, type, label, type_name)])
# types: s=string, b=bool, i64=int64, d=double, by=bytes, u32=uint32, f64=fixed64,
# f32=fixed32, i32=int32, m:<Msg>=message; label r=repeated
_MESSAGES = [
    ("AnyValue", [("string_value", 1, "s", "", None), ("bool_value", 2, "b", "", None),
                  ("int_value", 3, "i64", "", None), ("double_value", 4, "d", "", None),
                  ("array_value", 5, "m", "", "ArrayValue"), ("kvlist_value", 6, "m", "", "KeyValueList"),
                  ("bytes_value", 7, "by", "", None)]),
    ("ArrayValue", [("values", 1, "m", "r", "AnyValue")]),
    ("KeyValueList", [("values", 1, "m", "r", "KeyValue")]),
    ("KeyValue", [("key", 1, "s", "", None), ("value", 2, "m", "", "AnyValue")]),
    ("InstrumentationScope", [("name", 1, "s", "", None), ("version", 2, "s", "", None),
                              ("attributes", 3, "m", "r", "KeyValue"),
                              ("dropped_attributes_count", 4, "u32", "", None)]),
    ("Resource", [("attributes", 1, "m", "r", "KeyValue"), ("dropped_attributes_count", 2, "u32", "", None)]),
    ("LogRecord", [("time_unix_nano", 1, "f64", "", None), ("observed_time_unix_nano", 11, "f64", "", None),
                   ("severity_number", 2, "i32", "", None), ("severity_text", 3, "s", "", None),
                   ("body", 5, "m", "", "AnyValue"), ("attributes", 6, "m", "r", "KeyValue"),
                   ("dropped_attributes_count", 7, "u32", "", None), ("flags", 8, "f32", "", None),
                   ("trace_id", 9, "by", "", None), ("span_id", 10, "by", "", None),
                   ("event_name", 12, "s", "", None)]),
    ("ScopeLogs", [("scope", 1, "m", "", "InstrumentationScope"), ("log_records", 2, "m", "r", "LogRecord"),
                   ("schema_url", 3, "s", "", None)]),
    ("ResourceLogs", [("resource", 1, "m", "", "Resource"), ("scope_logs", 2, "m", "r", "ScopeLogs"),
                      ("schema_url", 3, "s", "", None)]),
    ("ExportLogsServiceRequest", [("resource_logs", 1, "m", "r", "ResourceLogs")]),
]

_ONEOF = {"AnyValue": {"string_value", "bool_value", "int_value", "double_value", "array_value",
                       "kvlist_value", "bytes_value"}}

_REQUEST_CLS = None


def _request_class():
    global _REQUEST_CLS
    if _REQUEST_CLS is not None:
        return _REQUEST_CLS
    if descriptor_pb2 is None:
        raise RuntimeError("protobuf runtime is not installed")
    fdp = descriptor_pb2.FieldDescriptorProto
    types = {"s": fdp.TYPE_STRING, "b": fdp.TYPE_BOOL, "i64": fdp.TYPE_INT64, "d": fdp.TYPE_DOUBLE,
             "by": fdp.TYPE_BYTES, "u32": fdp.TYPE_UINT32, "f64": fdp.TYPE_FIXED64,
             "f32": fdp.TYPE_FIXED32, "i32": fdp.TYPE_INT32, "m": fdp.TYPE_MESSAGE}
    fproto = descriptor_pb2.FileDescriptorProto(name="logpond_otlp_logs.proto", package=_PKG, syntax="proto3")
    for msg_name, fields in _MESSAGES:
        m = fproto.message_type.add(name=msg_name)
        oneof = _ONEOF.get(msg_name)
        if oneof:
            m.oneof_decl.add(name="value")
        for name, num, typ, label, type_name in fields:
            f = m.field.add(name=name, number=num, type=types[typ],
                            label=fdp.LABEL_REPEATED if label == "r" else fdp.LABEL_OPTIONAL)
            if type_name:
                f.type_name = f".{_PKG}.{type_name}"
            if oneof and name in oneof:
                f.oneof_index = 0
    pool = descriptor_pool.DescriptorPool()
    pool.Add(fproto)
    desc = pool.FindMessageTypeByName(f"{_PKG}.ExportLogsServiceRequest")
    _REQUEST_CLS = message_factory.GetMessageClass(desc)
    return _REQUEST_CLS


def _b64_to_hex(s: str) -> str:
    return base64.b64decode(s).hex()


def _hex_to_b64(s: str) -> str:
    return base64.b64encode(bytes.fromhex(s)).decode()


def _walk_ids(d: dict, conv) -> None:
    for rl in d.get("resourceLogs", []) or []:
        for sl in rl.get("scopeLogs", []) or []:
            for rec in sl.get("logRecords", []) or []:
                for k in ("traceId", "spanId"):
                    if rec.get(k):
                        rec[k] = conv(rec[k])


def proto_to_dict(data: bytes) -> dict:
    """Binary ExportLogsServiceRequest -> OTLP/JSON object (ids as hex,
    severity as integer, 64-bit integers as strings)."""
    msg = _request_class()()
    msg.ParseFromString(data)
    d = json_format.MessageToDict(msg, use_integers_for_enums=True)
    _walk_ids(d, _b64_to_hex)
    return d


def _text(v) -> str | None:
    """The text of a value; None where no kind is set."""
    from logpond.functions.values import raw_from_message, raw_text
    kind = v.WhichOneof("value")
    if kind == "string_value":
        return v.string_value
    return None if kind is None else raw_text(raw_from_message(v))


class _Lists:
    """A list column under construction: ends of the lists, values by field."""

    def __init__(self, *fields: str):
        self.ends = [0]
        self.fields = {f: [] for f in fields}

    def mark(self) -> tuple:
        return len(self.ends), [len(v) for v in self.fields.values()]

    def back(self, mark: tuple) -> None:
        del self.ends[mark[0]:]
        for v, n in zip(self.fields.values(), mark[1]):
            del v[n:]


def _strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def _structs(fields: dict[str, pa.Array], names: T.StructType, n: int) -> pa.Array:
    """A struct array of the Spark type; fields that are not given are null."""
    from pyspark.sql.pandas.types import to_arrow_type
    return pa.StructArray.from_arrays(
        [fields[f.name] if f.name in fields else pa.nulls(n, to_arrow_type(f.dataType)) for f in names.fields],
        names=names.fieldNames())


class RequestColumns:
    """Decoded requests as nested Arrow columns in the JSON parser's schema
    (``otlp_json.RESOURCE_LOGS_TYPE``): the wire format is read field by field
    into flat lists, one per column, and list ends; no object per record and no
    JSON text. Values are texts already, ids hexadecimal, fields that the
    flatten does not read stay null. A request with an id of another length is
    rejected whole, as the OTLP decoder does."""

    def __init__(self):
        self.null, self.resources = [], _Lists()
        self.scopes = _Lists("name", "version")                        # by resource
        self.records = _Lists("timeUnixNano", "observedTimeUnixNano", "severityNumber", "severityText", "body",
                              "traceId", "spanId")                     # by scope
        self.resource_kvs, self.record_kvs = _Lists("key", "value"), _Lists("key", "value")
        self.parts = (self.resources, self.scopes, self.records, self.resource_kvs, self.record_kvs)
        self.numbers: dict[int, str] = {}

    def add_null(self) -> None:
        self.null.append(True)
        self.resources.ends.append(self.resources.ends[-1])

    def add(self, data: bytes) -> None:
        msg = _request_class()()
        msg.ParseFromString(data)
        marks = [p.mark() for p in self.parts]
        try:
            self._add(msg)
        except Exception:
            for p, m in zip(self.parts, marks):
                p.back(m)
            raise
        self.null.append(False)

    def _add(self, msg) -> None:
        scope_name, scope_version = self.scopes.fields["name"].append, self.scopes.fields["version"].append
        r = self.records.fields
        time, observed, number, level, body, trace, span = (
            r[k].append for k in ("timeUnixNano", "observedTimeUnixNano", "severityNumber", "severityText", "body",
                                  "traceId", "spanId"))
        key, value, kv_end = self.record_kvs.fields["key"].append, self.record_kvs.fields["value"].append, self.record_kvs.ends.append
        keys = self.record_kvs.fields["key"]
        numbers = self.numbers
        for rl in msg.resource_logs:
            for kv in rl.resource.attributes:
                self.resource_kvs.fields["key"].append(kv.key)
                self.resource_kvs.fields["value"].append(_text(kv.value))
            self.resource_kvs.ends.append(len(self.resource_kvs.fields["key"]))
            for sl in rl.scope_logs:
                scope_name(sl.scope.name)
                scope_version(sl.scope.version)
                for rec in sl.log_records:
                    tid, sid = rec.trace_id, rec.span_id
                    if len(tid) not in (0, 16) or len(sid) not in (0, 8):
                        raise ValueError("invalid trace or span id length")
                    time(str(rec.time_unix_nano))
                    observed(str(rec.observed_time_unix_nano))
                    n = rec.severity_number
                    number(numbers.get(n) or numbers.setdefault(n, str(n)))
                    level(rec.severity_text)
                    trace(tid.hex())
                    span(sid.hex())
                    body(_text(rec.body) if rec.HasField("body") else None)
                    for kv in rec.attributes:
                        v = kv.value
                        key(kv.key)
                        value(v.string_value if v.WhichOneof("value") == "string_value" else _text(v))
                    kv_end(len(keys))
                self.records.ends.append(len(r["traceId"]))
            self.scopes.ends.append(len(self.scopes.fields["name"]))
        self.resources.ends.append(len(self.scopes.ends) - 1)

    def _kvs(self, lists: _Lists) -> pa.Array:
        from logpond.functions.values import ANY_VALUE_TYPE, KEY_VALUE_TYPE
        n = len(lists.fields["key"])
        values = _structs({"stringValue": _strings(lists.fields["value"])}, ANY_VALUE_TYPE, n)
        kv = _structs({"key": _strings(lists.fields["key"]), "value": values}, KEY_VALUE_TYPE, n)
        return pa.ListArray.from_arrays(pa.array(lists.ends, pa.int32()), kv)

    def array(self) -> pa.Array:
        from logpond.functions.values import ANY_VALUE_TYPE
        from logpond.sources.otlp_json import LOG_RECORD_TYPE, RESOURCE_LOGS_TYPE, SCOPE_LOGS_TYPE
        f = self.records.fields
        n = len(f["traceId"])
        columns = {k: _strings(v) for k, v in f.items() if k != "body"}
        columns["body"] = _structs({"stringValue": _strings(f["body"])}, ANY_VALUE_TYPE, n)
        columns["attributes"] = self._kvs(self.record_kvs)
        records = pa.ListArray.from_arrays(pa.array(self.records.ends, pa.int32()), _structs(columns, LOG_RECORD_TYPE, n))
        n = len(self.scopes.fields["name"])
        scope = _structs({k: _strings(v) for k, v in self.scopes.fields.items()}, SCOPE_LOGS_TYPE["scope"].dataType, n)
        scopes = pa.ListArray.from_arrays(pa.array(self.scopes.ends, pa.int32()),
                                          _structs({"scope": scope, "logRecords": records}, SCOPE_LOGS_TYPE, n))
        n = len(self.scopes.ends) - 1
        resource = _structs({"attributes": self._kvs(self.resource_kvs)}, RESOURCE_LOGS_TYPE["resource"].dataType, n)
        logs = _structs({"resource": resource, "scopeLogs": scopes}, RESOURCE_LOGS_TYPE, n)
        return pa.ListArray.from_arrays(pa.array(self.resources.ends, pa.int32()), logs, mask=pa.array(self.null, pa.bool_()))


def _set_any(m, v: dict) -> None:
    if not isinstance(v, dict) or not v:
        return
    if "stringValue" in v:
        m.string_value = v["stringValue"] or ""
    elif "boolValue" in v:
        m.bool_value = bool(v["boolValue"])
    elif "intValue" in v:
        m.int_value = int(v["intValue"])
    elif "doubleValue" in v:
        m.double_value = float(v["doubleValue"])
    elif "bytesValue" in v:
        m.bytes_value = base64.b64decode(v["bytesValue"] or "")
    elif "arrayValue" in v:
        m.array_value.SetInParent()
        for x in (v["arrayValue"] or {}).get("values", []) or []:
            _set_any(m.array_value.values.add(), x)
    elif "kvlistValue" in v:
        m.kvlist_value.SetInParent()
        _set_kvs(m.kvlist_value.values, (v["kvlistValue"] or {}).get("values"))


def _set_kvs(target, kvs) -> None:
    for kv in kvs or []:
        item = target.add()
        item.key = kv.get("key", "") or ""
        _set_any(item.value, kv.get("value") or {})


def _severity_int(v) -> int:
    if v is None or v == "":
        return 0
    if isinstance(v, int):
        return v
    s = str(v)
    if s.lstrip("-").isdigit():
        return int(s)
    from logpond.sources.otlp_json import SEVERITY_ENUM_BASE
    name = s.removeprefix("SEVERITY_NUMBER_")
    suffix = name[-1] if name[-1:] in "234" else ""
    base = SEVERITY_ENUM_BASE.get(name[:-1] if suffix else name, 0)
    return base + (int(suffix) - 1 if suffix and base else 0)


def dict_to_proto(d: dict) -> bytes:
    """OTLP/JSON object -> binary ExportLogsServiceRequest, by direct field
    assignment (ids from hex, times from decimal strings)."""
    msg = _request_class()()
    for rl in d.get("resourceLogs", []) or []:
        r = msg.resource_logs.add()
        _set_kvs(r.resource.attributes, (rl.get("resource") or {}).get("attributes"))
        for sl in rl.get("scopeLogs", []) or []:
            s = r.scope_logs.add()
            sc = sl.get("scope") or {}
            s.scope.name = sc.get("name", "") or ""
            s.scope.version = sc.get("version", "") or ""
            _set_kvs(s.scope.attributes, sc.get("attributes"))
            for rec in sl.get("logRecords", []) or []:
                lr = s.log_records.add()
                lr.time_unix_nano = int(rec.get("timeUnixNano") or 0)
                lr.observed_time_unix_nano = int(rec.get("observedTimeUnixNano") or 0)
                lr.severity_number = _severity_int(rec.get("severityNumber"))
                lr.severity_text = rec.get("severityText", "") or ""
                if rec.get("body"):
                    _set_any(lr.body, rec["body"])
                _set_kvs(lr.attributes, rec.get("attributes"))
                if rec.get("traceId"):
                    lr.trace_id = bytes.fromhex(rec["traceId"])
                if rec.get("spanId"):
                    lr.span_id = bytes.fromhex(rec["spanId"])
    return msg.SerializeToString()


def json_to_proto(text: str) -> bytes:
    """OTLP/JSON text -> binary ExportLogsServiceRequest."""
    return dict_to_proto(json.loads(text))


@F.pandas_udf(T.BinaryType())
def _json_to_proto_udf(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else json_to_proto(t) for t in text])


def json_text_to_proto(text: Column) -> Column:
    return _json_to_proto_udf(text)
