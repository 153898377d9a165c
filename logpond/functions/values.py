"""Attribute and value helpers.

OTLP values (``AnyValue``) are read as a struct with one member per kind;
nested kinds (array, kvlist) are kept as raw JSON text. Scalars become text
with JVM expressions. In the standalone column functions below, only values
that hold a nested array / kvlist go through a pandas UDF; for every other row
the UDF input is NULL. In the decode job the codec step gives payloads with
nested values their texts (``rewrite_values_to_text``), so its flatten is pure
JVM.
"""

from __future__ import annotations

import base64
import json
import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logpond import schema as S

# OTLP/JSON AnyValue as read by from_json; nested kinds stay raw JSON text.
ANY_VALUE_TYPE = T.StructType([
    T.StructField("stringValue", T.StringType()),
    T.StructField("boolValue", T.BooleanType()),
    T.StructField("intValue", T.StringType()),
    T.StructField("doubleValue", T.DoubleType()),
    T.StructField("arrayValue", T.StringType()),
    T.StructField("kvlistValue", T.StringType()),
    T.StructField("bytesValue", T.StringType()),
])
KEY_VALUE_TYPE = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", ANY_VALUE_TYPE),
])

_DEC_MIN, _DEC_MAX = 1e-6, 1e21


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Python side: text form of any value (used for nested values only)
# ---------------------------------------------------------------------------
def float_text(f: float) -> str:
    """Shortest round-trip text, plain notation for 1e-6 <= |f| < 1e21,
    exponent form (``1e+21``, ``1.5e-7``) outside."""
    if math.isnan(f) or math.isinf(f):
        return "json: unsupported value: " + ("NaN" if math.isnan(f) else ("+Inf" if f > 0 else "-Inf"))
    if f == 0:
        return "-0" if math.copysign(1.0, f) < 0 else "0"
    a = abs(f)
    r = repr(f)
    if a < 1e-6 or a >= 1e21:
        mant, _, exp = f"{f:e}".partition("e")
        # shortest mantissa: take digits from repr
        d = Decimal(r)
        sign, digits, _ = d.as_tuple()
        ds = "".join(map(str, digits)).rstrip("0") or "0"
        mant = ds[0] + ("." + ds[1:] if len(ds) > 1 else "")
        e = d.adjusted()
        return ("-" if sign else "") + mant + "e" + ("-" if e < 0 else "+") + str(abs(e))
    s = format(Decimal(r), "f")
    if "." in s:
        s = s.rstrip("0").rstrip(".")
    return s


def _raw(v: dict):
    """AnyValue JSON object -> plain Python value (the 'raw' form)."""
    if not isinstance(v, dict) or not v:
        return None
    if "stringValue" in v:
        return v["stringValue"]
    if "boolValue" in v:
        return bool(v["boolValue"])
    if "intValue" in v:
        return int(v["intValue"])
    if "doubleValue" in v:
        return float(v["doubleValue"])
    if "bytesValue" in v:
        return _Bytes(v["bytesValue"] or "")
    if "arrayValue" in v:
        av = v["arrayValue"]
        av = json.loads(av) if isinstance(av, str) else (av or {})
        return [_raw(x) for x in av.get("values", []) or []]
    if "kvlistValue" in v:
        kv = v["kvlistValue"]
        kv = json.loads(kv) if isinstance(kv, str) else (kv or {})
        out = {}
        for item in kv.get("values", []) or []:
            out[item.get("key", "")] = _raw(item.get("value") or {})
        return out
    return None


class _Bytes(str):
    """Base64 text of a bytes value (already base64 in OTLP/JSON)."""


def _json_text(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        return str(x)
    if isinstance(x, float):
        return float_text(x)
    if isinstance(x, str):
        s = json.dumps(str(x), ensure_ascii=False)
        return s.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026") \
            .replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    if isinstance(x, list):
        return "[" + ",".join(_json_text(e) for e in x) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(_json_text(k) + ":" + _json_text(x[k]) for k in sorted(x)) + "}"
    return json.dumps(x)


def raw_from_message(v):
    """AnyValue protobuf message -> plain Python value (the 'raw' form)."""
    kind = v.WhichOneof("value")
    if kind is None:
        return None
    if kind == "string_value":
        return v.string_value
    if kind == "bool_value":
        return v.bool_value
    if kind == "int_value":
        return v.int_value
    if kind == "double_value":
        return v.double_value
    if kind == "bytes_value":
        return _Bytes(base64.b64encode(v.bytes_value).decode())
    if kind == "array_value":
        return [raw_from_message(x) for x in v.array_value.values]
    out = {}
    for kv in v.kvlist_value.values:
        out[kv.key] = raw_from_message(kv.value)
    return out


def raw_text(raw) -> str:
    """Text form of a raw value (see ``any_value_text_py``)."""
    if raw is None:
        return ""
    if isinstance(raw, _Bytes):
        return str(raw)
    if isinstance(raw, bool):
        return "true" if raw else "false"
    if isinstance(raw, int):
        return str(raw)
    if isinstance(raw, float):
        return float_text(raw)
    if isinstance(raw, str):
        return raw
    return _json_text(raw)


def any_value_text_py(v: dict | None) -> str:
    """Text form of one AnyValue (dict as in OTLP/JSON)."""
    raw = _raw(v or {})
    if raw is None:
        return ""
    if isinstance(raw, _Bytes):
        return str(raw)
    if isinstance(raw, bool):
        return "true" if raw else "false"
    if isinstance(raw, int):
        return str(raw)
    if isinstance(raw, float):
        return float_text(raw)
    if isinstance(raw, str):
        return raw
    return _json_text(raw)


# value kinds other than stringValue, as JSON keys
NON_STRING_KINDS = ("intValue", "doubleValue", "boolValue", "bytesValue", "arrayValue", "kvlistValue")


def _as_string_value(v):
    if not isinstance(v, dict) or not v or "stringValue" in v:
        return v
    return {"stringValue": any_value_text_py(v)}


def rewrite_values_to_text(req: dict) -> dict:
    """Replace every non-string value of an OTLP/JSON request (resource,
    scope and record attributes, record bodies) by its text form as a
    ``stringValue``, so the JVM flatten only ever meets strings."""
    def kvs(lst):
        for kv in lst or []:
            if isinstance(kv, dict) and "value" in kv:
                kv["value"] = _as_string_value(kv["value"])
    for rl in req.get("resourceLogs", []) or []:
        kvs((rl.get("resource") or {}).get("attributes"))
        for sl in rl.get("scopeLogs", []) or []:
            kvs((sl.get("scope") or {}).get("attributes"))
            for rec in sl.get("logRecords", []) or []:
                kvs(rec.get("attributes"))
                if "body" in rec:
                    rec["body"] = _as_string_value(rec["body"])
    return req


@F.pandas_udf(T.StringType())
def _nested_value_text(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else any_value_text_py(json.loads(s)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nested_attrs_text(values: pd.Series) -> pd.Series:
    def conv(s):
        if s is None:
            return None
        return [any_value_text_py((kv or {}).get("value") or {}) for kv in json.loads(s)]
    return values.map(conv)


# ---------------------------------------------------------------------------
# JVM side
# ---------------------------------------------------------------------------
def double_text(d: Column) -> Column:
    """``float_text`` as an expression: the digits and the exponent are taken
    from Java's text of the double (shortest from Java 19 on) and set anew."""
    raw = d.cast("string")
    part = [F.regexp_extract(raw, r"^(-?)(\d+)\.(\d+)(?:E(-?\d+))?$", k) for k in range(1, 5)]
    sign, whole, e = part[0], part[1], F.coalesce(part[3].try_cast("int"), F.lit(0))
    fraction = F.regexp_replace(part[2], "0+$", "")
    size = F.char_length(fraction)
    digits = F.concat(whole, fraction)
    point = F.char_length(whole) + e              # digits before the point
    exponent = F.concat(whole, F.when(size > 0, F.concat(F.lit("."), fraction)).otherwise(F.lit("")), F.lit("e"),
                        F.when(e < 0, F.lit("-")).otherwise(F.lit("+")), F.abs(e).cast("string"))
    plain = (F.when(part[3] == "", F.concat(whole, F.when(size > 0, F.concat(F.lit("."), fraction)).otherwise(F.lit(""))))
             .when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
             .when(size <= e, F.concat(digits, F.repeat(F.lit("0"), e - size)))
             .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size))))
    a = F.abs(d)
    return (F.when(F.isnan(d), F.lit("json: unsupported value: NaN"))
            .when(a == F.lit(float("inf")), F.concat(F.lit("json: unsupported value: "),
                                                     F.when(d > 0, F.lit("+Inf")).otherwise(F.lit("-Inf"))))
            .when(d.isNotNull(), F.concat(sign, F.when((a != 0) & ((a < _DEC_MIN) | (a >= _DEC_MAX)), exponent).otherwise(plain))))


def _needs_python(v: Column) -> Column:
    return (v["stringValue"].isNull() & v["boolValue"].isNull() & v["intValue"].isNull()
            & v["bytesValue"].isNull() & v["doubleValue"].isNull()
            & (v["arrayValue"].isNotNull() | v["kvlistValue"].isNotNull()))


def scalar_value_text(v: Column) -> Column:
    """P10 for scalar kinds; NULL for nested kinds (see ``any_value_text``)."""
    return F.when(_needs_python(v), F.lit(None).cast("string")).otherwise(F.coalesce(
        v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["bytesValue"],
        double_text(v["doubleValue"]), F.lit("")))


def any_value_text(v) -> Column:
    """P10: text of one AnyValue struct column (string kind first)."""
    v = _col(v)
    py = _nested_value_text(F.when(v["stringValue"].isNull() & _needs_python(v), F.to_json(v)))
    return F.coalesce(v["stringValue"], scalar_value_text(v), py, F.lit(""))


def attrs_keys(attrs) -> Column:
    """Key list of an attribute list (order and duplicates kept)."""
    return F.transform(F.coalesce(_col(attrs), F.array().cast(T.ArrayType(KEY_VALUE_TYPE))), lambda a: a["key"])


def attrs_values_text(attrs) -> Column:
    """P11 + P10: value texts parallel to ``attrs_keys``.

    Common case first: when every value holds a ``stringValue`` (checked
    without a lambda: ``array_contains`` is NULL exactly when the probe is
    absent and a NULL element exists), the texts are that field, extracted
    by codegen'd array-of-struct field access. Other lists take per-element
    JVM text; nested values go to Python."""
    attrs = _col(attrs)
    empty = F.array().cast(T.ArrayType(T.StringType()))
    strings = attrs["value"]["stringValue"]
    all_strings = F.array_contains(strings, F.lit("\u0001")).isNotNull()
    py_in = F.when(attrs.isNull() | all_strings, F.lit(None).cast("string")) \
        .when(F.exists(attrs, lambda a: _needs_python(a["value"])), F.to_json(attrs))
    py = _nested_attrs_text(py_in)
    jvm = F.transform(attrs, lambda a: scalar_value_text(a["value"]))
    return (F.when(attrs.isNull(), empty).when(all_strings, strings)
            .when(py.isNotNull(), py).otherwise(jvm))


def service_name_from(keys, values) -> Column:
    """Last non-empty ``service.name`` value, else ``unknown``."""
    keys, values = _col(keys), _col(values)
    hits = F.filter(
        F.transform(keys, lambda k, i: F.when((k == S.SERVICE_NAME_KEY) & (F.get(values, i) != ""), F.get(values, i))),
        lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit(S.UNKNOWN_SERVICE))


def default_time_nanos(nanos, batch_nanos) -> Column:
    """A missing (NULL or 0) time becomes the batch clock."""
    nanos = _col(nanos)
    return F.when(nanos.isNull() | (nanos == 0), _col(batch_nanos)).otherwise(nanos)


def nanos_to_ts(nanos) -> Column:
    """Nanoseconds since epoch -> TIMESTAMP (micro precision; the nanos
    column keeps the rest)."""
    # exact integer division (a double division loses the last digits)
    micros = F.floor(_col(nanos).cast("decimal(20,0)") / F.lit(1000)).cast("bigint")
    return F.timestamp_micros(micros)


def id_hex(raw, n_bytes: int) -> Column:
    """Raw id bytes -> lower hex; NULL or empty -> all zeros."""
    raw = _col(raw)
    zeros = F.lit("0" * (2 * n_bytes))
    return F.when(raw.isNull() | (F.length(raw) == 0), zeros).otherwise(F.lower(F.hex(raw)))


def id_text(text, n_bytes: int) -> Column:
    """OTLP/JSON ids are hex already; empty -> all zeros, else lower case."""
    text = _col(text)
    zeros = F.lit("0" * (2 * n_bytes))
    return F.when(text.isNull() | (text == ""), zeros).otherwise(F.lower(text))


def unflatten_attrs(keys, values) -> Column:
    """Zip keys with values; a missing value becomes '' and extra values
    are dropped (unlike ``arrays_zip``, which pads to the longer side)."""
    keys = F.coalesce(_col(keys), F.array().cast(T.ArrayType(T.StringType())))
    values = _col(values)
    return F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.coalesce(F.get(values, i), F.lit("")).alias("value")))


def live_tail_attrs(keys, values) -> Column:
    """As P13 but a missing value stays NULL; NULL keys -> []."""
    keys = F.coalesce(_col(keys), F.array().cast(T.ArrayType(T.StringType())))
    values = _col(values)
    return F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.get(values, i).alias("value")))
