import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from logpond.llm import op6_warc as op


def record(payload=b"hello", kind="response", page=1, digest=None):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    digest = digest or base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
            f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n").encode()
    return head + block + b"\r\n\r\n"


def covered(data):
    """Every byte is in a record, a gap, or CRLF padding."""
    at = 0
    for _, o, n, *_ in op.salvage(data):
        assert o >= at and set(data[at:o]) <= {13, 10}
        at = o + n
    assert set(data[at:]) <= {13, 10}


def pages(data):
    return [op._page(x[3]["warc-record-id"]) for x in op.salvage(data) if x[0] == "record"]


def gaps(data):
    return [(x[1], x[2]) for x in op.salvage(data) if x[0] == "gap"]


PAYLOADS = [b"", b"one", b"WARC/1.1\r\nnot a record", b"\x1f\x8b\x08 no gzip", b"x" * 5000, "é\r\n\r\n".encode() * 9]


@pytest.mark.parametrize("zipped", [False, True])
def test_whole_and_damaged(zipped):
    recs = [record(p, page=i) for i, p in enumerate(PAYLOADS)]
    if zipped:
        recs = [gzip.compress(r) for r in recs]
    data = b"".join(recs)
    assert pages(data) == list(range(6)) and not gaps(data)
    starts = [sum(map(len, recs[:i])) for i in range(7)]
    for i in range(6):                       # one record cut off, overwritten, or losing bytes
        cut = data[:starts[i] + len(recs[i]) // 2] + data[starts[i + 1]:]
        assert [p for p in pages(cut) if p != i] == [p for p in range(6) if p != i]
        covered(cut)
        bad = bytearray(data)
        bad[starts[i]:starts[i] + 9] = b"#########"
        assert pages(bytes(bad)) == [p for p in range(6) if p != i]
        assert gaps(bytes(bad)) == [(starts[i], len(recs[i]))]
    assert pages(b"junk before" + data + b"tail") == list(range(6))
    covered(b"junk before" + data + b"tail")


def test_checks():
    bad = record(b"one", page=1, digest="A" * 32)
    wrong = record(b"two", page=2).replace(b"Content-Length: 22", b"Content-Length: 21")
    data = bad + record(b"three", page=3) + wrong + record(b"four", page=4)
    assert pages(data) == [3, 4]
    assert gaps(data) == [(0, len(bad)), (len(bad) + len(record(b"three", page=3)), len(wrong))]
    several = gzip.compress(record(page=7) + record(page=8))
    assert pages(several) == [7, 8]


def test_random_damage_never_crashes():
    rng = random.Random(5)
    data = b"".join(gzip.compress(record(p, page=i)) if i % 2 else record(p, page=i) for i, p in enumerate(PAYLOADS))
    for _ in range(300):
        b = bytearray(data)
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(b))
            if rng.random() < .5:
                b[at:at + rng.randrange(40)] = rng.randbytes(rng.randrange(40))
            else:
                b[at] ^= 1 << rng.randrange(8)
        covered(bytes(b))


ROWS = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "x y\r\nz", ""), (5, "u", "é€\r\n\r\nWARC/1.1\r\n"),
        (2, "http://b", "same"), (1, "again", "same"), (None, "n", "none"), (None, "n", "same"), (6, "l", "z" * 200000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int")
    got = op.round_trip(df).collect()
    assert {r["kind"] for r in got} == {"record"}
    low = {}
    for i, _, h in ROWS:
        if i is not None:
            low[h or ""] = min(i, low.get(h or "", i))
    want = []
    for i, _, h in ROWS:
        p = (h or "").encode()
        f = low.get(h or "")
        revisit = f is not None and i != f
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(),
                     "revisit" if revisit else "response", f if revisit else None))
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"]) for r in got],
                  key=str) == sorted(want, key=str)
    assert op.round_trip(df.where(F.lit(False))).count() == 0


def test_damaged_archive_through_spark(spark, tmp_path):
    data = record(b"a", page=1) + b"#" + record(b"b", page=2)[5:] + record(b"c", page=3)
    (tmp_path / "x.warc").write_bytes(data)
    got = op.read_archives(spark, str(tmp_path), with_payload=True).collect()
    assert [(r["page_id"], r["payload"]) for r in got if r["kind"] == "record"] == [(1, b"a"), (3, b"c")]
    gap = [r for r in got if r["kind"] == "gap"]
    assert len(gap) == 1 and gap[0]["length"] == len(record(b"b", page=2)) - 4 and gap[0]["reason"]


def test_digests_by_value_and_folded_headers():
    sha = hashlib.sha1(b"one").digest()
    forms = [sha.hex(), sha.hex().upper(), base64.b32encode(sha).decode().lower()]
    data = b"".join(record(b"one", page=i, digest=d) for i, d in enumerate(forms))
    folded = record(b"one", page=3).replace(b"Content-Type: application/http; ", b"Content-Type: application/http;\r\n\t ")
    sha256 = record(b"one", page=4, digest="x").replace(b"sha1:x", b"sha256:" + hashlib.sha256(b"one").hexdigest().encode())
    unknown = record(b"one", page=5, digest="x").replace(b"sha1:x", b"crc32:00000000")
    assert pages(data + folded + sha256 + unknown) == list(range(6)) and not gaps(data + folded + sha256 + unknown)
    wrong = [record(b"one", page=1, digest=hashlib.sha1(b"two").hexdigest()), record(b"one", page=2, digest="abc"),
             record(b"one", page=3, digest="not hexadecimal, but forty digits long!!")]
    assert pages(b"".join(wrong)) == []


def test_a_cut_member_gives_its_whole_records():
    rng = random.Random(8)
    recs = [record(rng.randbytes(300), page=i) for i in range(100)]
    data = gzip.compress(b"".join(recs))
    got = pages(data[:-200])
    assert got == list(range(len(got))) and len(got) >= 98
    assert [g for g in gaps(data[:-200])]
    after = record(b"next", page=500)
    assert pages(data[:-200] + after)[-1] == 500 and len(pages(data[:-200] + after)) >= 99
    # one byte flipped in the middle, another member behind it
    bad = bytearray(data)
    bad[len(bad) // 2] ^= 255
    got = pages(bytes(bad) + gzip.compress(record(b"x", page=600)))
    assert got[-1] == 600 and got[:40] == list(range(40)) and set(got) <= {*range(100), 600}
    # without a digest, what a damaged member holds is not trusted
    blind = [r.replace(b"sha1:", b"none:") for r in recs]
    assert pages(gzip.compress(b"".join(blind))[:-200]) == []


def test_many_members_in_proportional_time():
    import time
    one = gzip.compress(record(b"payload" * 100, page=1))
    times = []
    for n in (5_000, 50_000):
        data = one * n
        t0 = time.perf_counter()
        assert sum(1 for x in op.salvage(data) if x[0] == "record") == n
        times.append(time.perf_counter() - t0)
    assert times[1] < 30 * times[0] + 1


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "ARCHIVE_BYTES", 100_000)
    df = spark.createDataFrame([(i, "u", chr(97 + i) * 30_000) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    op.write_archives(df, f"{tmp_path}/w")
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert len(sizes) >= 7 and max(sizes) <= 100_000
    assert op.read_archives(spark, f"{tmp_path}/w/part-*").where("kind = 'record'").count() == 20
