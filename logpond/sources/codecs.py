"""Payload codecs: compression sniffing (P2), gzip / zstd (P1) and the
decode job's single codec round trip.

Sniffing is a JVM expression. (De)compression needs Python; it runs in
Arrow-batched pandas UDFs, one call per envelope (not per record).
``decompress`` (P1 on its own) hands Python only gzip / zstd rows.
``payload_codec`` (the decode job) also decodes protobuf payloads, straight
into typed Arrow columns, and rewrites JSON payloads with nested values. Plain
JSON without nested values never reaches Python.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logpond import schema as S

try:  # gated: zstandard is optional
    import zstandard as _zstd
except ImportError:  # pragma: no cover
    _zstd = None

CODEC_RESULT = T.StructType([
    T.StructField("payload", T.BinaryType()),
    T.StructField("error", T.StringType()),
])


def sniff_compression(payload) -> Column:
    """``zstd`` / ``gzip`` by magic bytes, else ``none``."""
    p = F.col(payload) if isinstance(payload, str) else payload
    head = F.hex(F.substring(p, 1, 4))
    return (F.when(head.startswith(S.ZSTD_MAGIC_HEX), F.lit("zstd"))
            .when(head.startswith(S.GZIP_MAGIC_HEX), F.lit("gzip"))
            .otherwise(F.lit("none")))


def _zstd_decompress(data: bytes) -> bytes:
    if _zstd is None:
        raise RuntimeError("zstandard is not installed")
    out = io.BytesIO()
    while True:                          # a payload may hold several frames
        dobj = _zstd.ZstdDecompressor().decompressobj()
        out.write(dobj.decompress(data))
        if not dobj.eof:
            raise ValueError("zstd: unexpected end of frame")
        data = dobj.unused_data
        if not data:
            return out.getvalue()


def decompress_bytes(data: bytes, encoding: str) -> bytes:
    if encoding == "gzip":
        return gzip.decompress(data)
    if encoding == "zstd":
        return _zstd_decompress(data)
    raise ValueError("unsupported encoding")


def compress_bytes(data: bytes, encoding: str) -> bytes:
    if encoding == "gzip":
        return gzip.compress(data, compresslevel=6, mtime=0)
    if encoding == "zstd":
        if _zstd is None:
            raise RuntimeError("zstandard is not installed")
        return _zstd.ZstdCompressor(level=3).compress(data)
    return data


@F.pandas_udf(CODEC_RESULT)
def _decompress_udf(payload: pd.Series, encoding: pd.Series) -> pd.DataFrame:
    out_p, out_e = [], []
    for data, enc in zip(payload, encoding):
        if data is None:
            out_p.append(None)
            out_e.append(None)
            continue
        try:
            out_p.append(decompress_bytes(bytes(data), enc))
            out_e.append(None)
        except Exception as e:  # noqa: BLE001 - any codec failure is a row error
            out_p.append(None)
            out_e.append(f"{enc} decompress error: {type(e).__name__}: {e}")
    return pd.DataFrame({"payload": out_p, "error": out_e})


@F.pandas_udf(T.BinaryType())
def _compress_udf(payload: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else compress_bytes(bytes(d), e) for d, e in zip(payload, encoding)])


def _enc(encoding) -> Column:
    e = F.col(encoding) if isinstance(encoding, str) else encoding
    return F.coalesce(e, F.lit(""))


def decompress(payload, encoding) -> Column:
    """P1 as a column: struct(payload, error).

    "", "none", "identity" (and NULL) pass through; gzip / zstd are
    decompressed; any other encoding is an error with the payload kept."""
    p = F.col(payload) if isinstance(payload, str) else payload
    enc = _enc(encoding)
    compressed = enc.isin("gzip", "zstd")
    py = _decompress_udf(F.when(compressed, p), enc)
    passthrough = enc.isin(*S.PASSTHROUGH_ENCODINGS)
    return (F.when(passthrough, F.struct(p.alias("payload"), F.lit(None).cast("string").alias("error")))
            .when(compressed, py)
            .otherwise(F.struct(p.alias("payload"), F.lit("unsupported encoding").alias("error"))))


def compress(payload, encoding) -> Column:
    """Encoder side of P1 (gzip / zstd; anything else unchanged)."""
    p = F.col(payload) if isinstance(payload, str) else payload
    enc = _enc(encoding)
    return F.when(enc.isin("gzip", "zstd"), _compress_udf(F.when(enc.isin("gzip", "zstd"), p), enc)).otherwise(p)


# JSON value kinds whose text needs Python (every other kind is a JVM expression)
NESTED_KEYS = (b'"arrayValue"', b'"kvlistValue"')


def codec_result(request: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("payload", T.BinaryType()),
        T.StructField("json", T.StringType()),
        T.StructField("request", request),
        T.StructField("error", T.StringType()),
    ])


def payload_codec(payload: Column, encoding: Column, is_proto: Column, request: T.DataType,
                  on_payload: Callable[[], None] | None = None) -> Column:
    """Decompression, protobuf decoding and the texts of nested JSON values in
    one Arrow round trip: struct(payload = decompressed JSON bytes, json = JSON
    text whose values became texts, request = a decoded protobuf request as
    typed columns, error). NULL payload in -> NULLs out. ``on_payload`` is
    called for every payload that Python handles (tests count them)."""

    @F.arrow_udf(codec_result(request))
    def codec(payloads: pa.Array, encodings: pa.Array, protos: pa.Array) -> pa.Array:
        import json

        from logpond.functions.values import rewrite_values_to_text
        from logpond.sources.otlp_proto import RequestColumns
        out_p, out_j, out_e, requests = [], [], [], RequestColumns()
        for data, enc, proto in zip(payloads, encodings.to_pylist(), protos.to_pylist()):
            raw, text, error = data.as_py(), None, None
            if raw is not None:
                if on_payload is not None:
                    on_payload()
                try:
                    if enc in ("gzip", "zstd"):
                        raw = decompress_bytes(raw, enc)
                except Exception as e:  # noqa: BLE001 - a codec failure is a row error
                    raw, error = None, f"{enc} decompress error: {type(e).__name__}: {e}"
            if raw is not None and proto:
                try:
                    requests.add(raw)
                except Exception as e:  # noqa: BLE001
                    requests.add_null()
                    error = f"protobuf decode error: {type(e).__name__}: {e}"
                raw = None
            else:
                requests.add_null()
                if raw is not None and any(k in raw for k in NESTED_KEYS):
                    try:
                        text = json.dumps(rewrite_values_to_text(json.loads(raw)), separators=(",", ":"))
                        raw = None
                    except Exception:  # noqa: BLE001 - leave invalid JSON to the JVM parser
                        pass
            out_p.append(raw)
            out_j.append(text)
            out_e.append(error)
        return pa.StructArray.from_arrays(
            [pa.array(out_p, pa.binary()), pa.array(out_j, pa.string()), requests.array(), pa.array(out_e, pa.string())],
            names=["payload", "json", "request", "error"])

    return codec(payload, encoding, is_proto)
