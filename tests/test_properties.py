"""Randomised checks against plain-Python statements of the same rules."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from logpond.functions.severity import severity_normalise
from logpond.operators import dashboards as D
from logpond.operators import rollups as R
from logpond.operators import search as Q
from tests.helpers import log_row, logs_df

T0 = dt.datetime(2024, 3, 1, 12, 0, 0)
SERVICES = ["api", "API-gw", "auth", "billing", "Batch", ""]
TEXTS = ["INFO", "ERROR", "Warn", "WARNING", "debug2", "FATAL", ""]


def random_rows(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        ts = T0 + dt.timedelta(seconds=rnd.randint(0, 240), microseconds=rnd.randint(0, 999999))
        rows.append(log_row(ts, rnd.choice(SERVICES), rnd.choice(TEXTS), rnd.randint(1, 24),
                            rnd.choice(["timeout on db", "ok", "user 42 logged in", "Retry 3/5"]),
                            f"{rnd.getrandbits(128):032x}", f"{rnd.getrandbits(64):016x}"))
    return rows


def py_match(r, f: Q.LogFilter):
    def prefix(v, p):
        return p == "" or v.lower().startswith(p.lower())
    return ((f.start is None or r["ts"] >= f.start) and (f.end is None or r["ts"] <= f.end)
            and prefix(r["service_name"], f.service_name) and prefix(r["severity_text"], f.severity_text)
            and (f.severity_number <= 0 or r["severity_number"] == f.severity_number)
            and (f.body == "" or f.body.lower() in r["body"].lower()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search_page_and_count_match_brute_force(spark, seed):
    rows = random_rows(seed)
    df = logs_df(spark, rows).cache()
    rnd = random.Random(seed * 7)
    for _ in range(4):
        f = Q.LogFilter(start=T0 + dt.timedelta(seconds=rnd.randint(0, 100)) if rnd.random() < 0.5 else None,
                        end=T0 + dt.timedelta(seconds=rnd.randint(100, 240)) if rnd.random() < 0.5 else None,
                        service_name=rnd.choice(["", "a", "API", "b"]), severity_text=rnd.choice(["", "w", "E"]),
                        severity_number=rnd.choice([-1, 0, 17, 9]), body=rnd.choice(["", "TIME", "user"]),
                        order_by=rnd.choice(["Timestamp", "ServiceName"]), descending=rnd.random() < 0.5,
                        limit=rnd.choice([0, 7, 25]), offset=rnd.choice([-2, 0, 5]))
        want = [r for r in rows if py_match(r, f)]
        key = (lambda r: (r["ts"], r["trace_id"], r["span_id"])) if f.order_by == "Timestamp" else \
            (lambda r: (r["service_name"], r["trace_id"], r["span_id"]))
        want.sort(key=key, reverse=f.descending)
        page = want[f.page_offset:f.page_offset + f.page_limit]
        got = [r["trace_id"] for r in Q.search_logs(df, f).collect()]
        assert got == [r["trace_id"] for r in page]
        assert Q.search_count(df, f).first()["total"] == len(want)
        p2, total = Q.search_page_with_total(df, f)
        assert total == len(want) and p2.count() == len(page)


@pytest.mark.parametrize("seed", [4, 5])
def test_gap_filled_series_matches_brute_force(spark, seed):
    rows = random_rows(seed, 600)
    m1s = R.metrics_1s(logs_df(spark, rows))
    as_of = T0 + dt.timedelta(seconds=150, milliseconds=400)
    end = as_of.replace(microsecond=0)
    start = end - dt.timedelta(seconds=60)
    counts = {}
    for r in rows:
        sec = r["ts"].replace(microsecond=0)
        if start <= sec < end and r["service_name"] != "":
            counts[(r["service_name"], sec)] = counts.get((r["service_name"], sec), 0) + 1
    services = {s for s, _ in counts}
    want = sorted((s, start + dt.timedelta(seconds=i), counts.get((s, start + dt.timedelta(seconds=i)), 0))
                  for s in services for i in range(60))
    got = sorted((r["service_name"], r["ts"].replace(tzinfo=None), r["logs_count"])
                 for r in D.ingestion_series(m1s, as_of).collect())
    assert got == want


def py_normalise(t):
    if not t:
        return "info"
    base = re.sub(r"\d+$", "", t).lower()
    return {"trace": "trace", "debug": "debug", "info": "info", "warning": "warn", "warn": "warn",
            "error": "error", "fatal": "fatal"}.get(base, "info")


def test_severity_normalise_matches_rule(spark):
    rnd = random.Random(9)
    words = ["trace", "DEBUG", "Info", "warning", "WARN", "error", "Fatal", "notice", "x", ""]
    texts = [rnd.choice(words) + rnd.choice(["", "1", "23", "4a"]) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["n"] for r in df.select(severity_normalise("t").alias("n")).collect()]
    assert got == [py_normalise(t) for t in texts]


def py_precision3(v):
    # JavaScript toPrecision(3) for 1 <= v < 1000 (half up on the value)
    for digits, lim in ((2, 10), (1, 100), (0, 1000)):
        if v < lim:
            r = int(v * 10 ** digits + 0.5) / 10 ** digits
            if r >= lim:
                return {10: "10.0", 100: "100", 1000: "1.00e+3"}[lim]
            return f"{r:.{digits}f}"


def test_short_number_matches_rule(spark):
    from logpond.functions.text import short_number
    rnd = random.Random(11)
    xs = [round(rnd.uniform(1, 9.99) * 10 ** rnd.randint(3, 11), rnd.randint(0, 3)) for _ in range(300)]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r["t"] for r in df.select(short_number("x").alias("t")).collect()]
    want = []
    for x in xs:
        for lim, suf in ((1e9, "B"), (1e6, "M"), (1e3, "k")):
            if x >= lim:
                want.append(py_precision3(x / lim) + suf)
                break
    assert got == want
