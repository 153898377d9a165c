"""WARC archives: a writer with revisit records and a salvage reader.

Writer: one WARC/1.1 record per page, written by Spark's text writer (the
record separator is the line separator), so archives go to any store that
Spark can write. A file holds at most ``RECORDS_A_FILE`` records, and fewer if
the longest payload would let it grow beyond ``ARCHIVE_BYTES``.
Pages of equal payload (by SHA-1) share one response record, that with the
smallest id; the others are revisits without the payload.

Reader: archives, plain or gzip (a member a record, or any other cut), are
read record by record. A record must have a version line, a Content-Length,
its whole block, the closing blank line and, for a response, the payload
digest it states (by value: base32 or hexadecimal, of either case; folded
header lines are one). When one of these checks fails, the reader searches for
the next gzip member or version line from which a whole record can be read,
goes on from there and logs the bytes between as a quarantined gap. A gzip
member that is cut or damaged is kept up to the damage: whole records in it
whose digest is right are recovered, the rest is a gap. Every byte of a file
is in a record, in the padding between records or in a gap.

Members are decompressed in chunks, so the time is in proportion to the
archive, however many members it has. An archive, and the text of one member
of it, are held in memory by the task that reads it, which bounds their size:
the reader fails on archives larger than
``spark.sql.sources.binaryFile.maxLength`` (2 GB), it never drops one.

Defined cases: a null html is an empty payload; rows that repeat an id and
its payload are responses all (none has a smaller id); null ids come after
all others, and among null ids alone every row is a response; a null url is
written as an empty target; an empty table gives no archive rows; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logpond.llm.common import pick, saved, small_side
from logpond.session import scratch_path

RECORDS_A_FILE = 2000
ARCHIVE_BYTES = 256 << 20     # of an archive, unless one record alone is larger
LEAST_SHARED = 0              # payloads of at least so many bytes are deduplicated
DATE = "2026-01-01T00:00:00Z"
#: Fixed by the WARC format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = ("file string, offset long, length long, kind string, reason string, type string, page_id long, "
          "payload_bytes long, payload_digest string, refers_to long, payload binary")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits make four letters."""
    x = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(x, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _BASE32_DIGITS, _BASE32)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """id, url, t (payload), digest, first (the response's id for a revisit,
    else null)."""
    p = pick(pages, id=id_col, url=url_col, t=html_col).select(
        "id", "url", F.coalesce("t", F.lit("")).alias("t"))
    p = p.withColumn("digest", base32_sha1(F.col("t").cast("binary")))
    shared = saved(p.where(F.octet_length("t") >= least).groupBy("digest").agg(
        F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1 and low is not null").select("digest", "low"), "shared")
    joined = p.join(small_side(shared, shared.count(), 100), "digest", "left")
    revisit = F.col("low").isNotNull() & ~F.col("id").eqNullSafe(F.col("low"))
    return joined.select("id", "url", "t", "digest", F.when(revisit, F.col("low")).alias("first"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least: int = LEAST_SHARED) -> None:
    d = with_revisits(pages, id_col, url_col, html_col, least)
    eol = "\r\n"
    size = F.octet_length("t").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), size,
                    F.lit(eol + eol))
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("t")))
    name = F.coalesce(F.col("id").cast("string"), F.lit("none"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    d = d.withColumn("block", block)
    longest = pick(pages, t=html_col).agg(F.max(F.octet_length("t")).alias("n")).first()["n"] or 0
    records = max(1, min(RECORDS_A_FILE, ARCHIVE_BYTES // (longest + 4096)))
    head = F.concat(
        F.lit(f"{VERSION}{eol}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{eol}WARC-Record-ID: <urn:page:"), name, F.lit(f">{eol}WARC-Date: {DATE}{eol}WARC-Target-URI: "), url,
        F.lit(f"{eol}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(f"{eol}X-Payload-Length: "), size,
        F.when(revisit, F.concat(F.lit(f"{eol}WARC-Refers-To: <urn:page:"), F.col("first").cast("string"),
                                 F.lit(f">{eol}WARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit(f"{eol}Content-Type: application/http; msgtype=response{eol}Content-Length: "),
        F.octet_length("block").cast("string"), F.lit(eol + eol))
    d.select(F.concat(head, F.col("block")).alias("value")).write.option("lineSep", eol + eol).option(
        "maxRecordsPerFile", records).text(path)


# ---- reader -----------------------------------------------------------------

_GZIP = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


class Damaged(Exception):
    pass


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", raw).split(b"\r\n")[1:]:      # folded lines are one
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        out[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return out


def _record(data: bytes, at: int) -> tuple[int, dict, bytes]:
    """(end, headers, block) of the record at ``at``; raises Damaged."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("header not closed")
    head = _headers(data[at:stop])
    size = head.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Damaged("no Content-Length")
    lo = stop + 4
    hi = lo + int(size)
    if hi > len(data):
        raise Damaged("block cut off")
    if data[hi:hi + 4] != b"\r\n\r\n":
        raise Damaged("no blank line after the block")
    block = data[lo:hi]
    if head.get("warc-type") == "response" and _verified(head, block) is False:
        raise Damaged("payload digest differs")
    return hi + 4, head, block


def payload_of(head: dict, block: bytes) -> bytes:
    """The block, without the HTTP header where there is one."""
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def stated_digest(head: dict) -> tuple[str, bytes] | None:
    """(algorithm, value) of the payload digest that a record states, in
    base32 or hexadecimal digits of either case; None if there is none that
    can be checked."""
    name, _, text = head.get("warc-payload-digest", "").partition(":")
    name = name.lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    size = hashlib.new(name).digest_size
    try:
        if len(text) == 2 * size:
            return name, bytes.fromhex(text)
        text = text.rstrip("=").upper()
        value = base64.b32decode(text + "=" * (-len(text) % 8))
    except ValueError:
        return None
    return (name, value) if len(value) == size else None


def _verified(head: dict, block: bytes) -> bool | None:
    """Whether the payload has the stated digest; None if none is stated (one
    that is no digest of its kind cannot be right)."""
    stated = stated_digest(head)
    if stated is None:
        known = re.match(r"(?i)(md5|sha-?1|sha-?256|sha-?512):", head.get("warc-payload-digest", ""))
        return False if known else None
    return hashlib.new(stated[0], payload_of(head, block)).digest() == stated[1]


CHUNK = 1 << 16


def _member(data: memoryview, at: int) -> tuple[int, bytes, str | None]:
    """(end, text, damage) of the gzip member at ``at``, read in bounded
    chunks. Of a cut or damaged member the text up to the damage is kept;
    ``end`` is then the first byte that could not be used."""
    def feed(lo: int, step: int, d, out: list) -> tuple[int, str | None]:
        while not d.eof:
            if lo >= len(data):
                return lo, "gzip member cut off"
            try:
                out.append(d.decompress(data[lo:lo + step]))
            except zlib.error as e:
                return lo, f"gzip member: {e}"
            lo += min(step, len(data) - lo)
        return lo - len(d.unused_data), None

    d, out = zlib.decompressobj(31), []
    end, why = feed(at, CHUNK, d, out)
    if why and end < len(data):
        # once more, byte by byte in the chunk that failed: its whole part counts
        failed, d, out = end, zlib.decompressobj(31), []
        lo = at
        while lo < failed:
            out.append(d.decompress(data[lo:min(lo + CHUNK, failed)]))
            lo = min(lo + CHUNK, failed)
        end, why = feed(lo, 1, d, out)
    return end, b"".join(out), why


def _read_at(data: bytes, at: int) -> tuple[int, list[tuple[int, int, dict, bytes]], list[tuple[int, int, str]]]:
    """(end, records, gaps) of the member or record at ``at``."""
    if data.startswith(_GZIP, at):
        end, inner, damage = _member(memoryview(data), at)
        found, gaps, lost = [], [], 0
        for kind, _, size, x, block in salvage(inner):
            # what a damaged member holds counts only if its digest says so
            if kind == "record" and (damage is None or _verified(x, block)):
                found.append((at, end - at, x, block))
            else:
                gaps.append((at, size, f"in a member: {x}"))
                lost += size
        if damage is not None:
            if not found:
                raise Damaged(damage)
            stop = _start_behind(data, at, end, {(x.get("warc-record-id"), y) for _, _, x, y in found})
            end = min(end, stop)
            return (stop, [(o, end - at, x, y) for o, _, x, y in found],
                    [(end, stop - end, f"{damage}; {lost} bytes of its text are in no record")])
        if inner and not found:
            raise Damaged("gzip member without a record")
        return end, found, gaps
    end, head, block = _record(data, at)
    return end, [(at, end - at, head, block)], []


def _start_behind(data: bytes, at: int, end: int, known: set) -> int:
    """Where reading goes on after the damaged member at ``at``: a cut member
    takes bytes of what follows it for its own until that fails at ``end``, so
    a start before ``end`` counts if a new record can be read there."""
    pos = at + 1
    while m := _START.search(data, pos):
        if m.start() >= end:
            return m.start()
        try:
            stop, found, _ = _read_at(data, m.start())
        except Damaged:
            pos = m.start() + 1
            continue
        if any((x.get("warc-record-id"), y) not in known for _, _, x, y in found):
            return m.start()
        pos = max(stop, m.start() + 1)
    return len(data)


def salvage(data: bytes):
    """("record", offset, length, headers, block) and ("gap", offset, length,
    reason, None) in order of place."""
    at, n = 0, len(data)
    lost, why = None, ""
    while at < n:
        if lost is None and data[at] in b"\r\n":          # padding
            at += 1
            continue
        try:
            end, found, gaps = _read_at(data, at)
        except Damaged as e:
            if lost is None:
                lost, why = at, str(e)
            m = _START.search(data, at + 1)
            at = m.start() if m else n
            continue
        if lost is not None:
            yield "gap", lost, at - lost, why, None
            lost = None
        for x in found:
            yield "record", *x
        for o, size, reason in gaps:
            yield "gap", o, size, reason, None
        at = end
    if lost is not None:
        yield "gap", lost, n - lost, why, None


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Rows of ``RECORD``: kind ``record`` for a whole record, ``gap`` for
    quarantined bytes with their reason."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(),
             pa.string(), pa.int64(), pa.binary()]

    def rows(name: str, data: bytes):
        for kind, at, size, head, block in salvage(data):
            if kind == "gap":
                yield name, at, size, kind, head, None, None, None, None, None, None
                continue
            payload = payload_of(head, block)
            revisit = head.get("warc-type") == "revisit"
            stated = stated_digest(head)
            if revisit and stated and stated[0] == "sha1":
                digest, length = base64.b32encode(stated[1]).decode(), head.get("x-payload-length", "")
                length = int(length) if length.isdigit() else None
            else:
                digest, length = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
            yield (name, at, size, kind, None, head.get("warc-type"), _page(head.get("warc-record-id")), length, digest,
                   _page(head.get("warc-refers-to")), payload if with_payload else None)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def each(batches):
        for b in batches:
            for k in range(b.num_rows):
                out, held = [], 0
                for r in rows(b.column(0)[k].as_py(), b.column(1)[k].as_py()):
                    out.append(r)
                    held += len(r[-1] or b"")
                    if len(out) >= 5000 or held > 16 << 20:
                        yield batch(out)
                        out, held = [], 0
                if out:
                    yield batch(out)

    return files.mapInArrow(each, RECORD)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least: int = LEAST_SHARED) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "llm-warc")
    write_archives(pages, path, id_col, url_col, html_col, least)
    return read_archives(spark, f"{path}/part-*")
