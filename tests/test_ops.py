import datetime as dt

import pytest
from pyspark.sql import functions as F

from logpond import schema as S
from logpond.functions.cards import dlq_state, error_level, log_rate_card
from logpond.functions.severity import severity_band, severity_normalise
from logpond.functions.text import body_hits, short_number
from logpond.operators import livetail as L
from logpond.operators import retry as RT
from logpond.operators.thresholds import default_bands, error_rate_band, threshold_violations
from tests.helpers import log_row, logs_df


@pytest.mark.parametrize("n,expected", [(3, 3), (0, 1), (1, 1), (10, 5), (5, 5), (7, 5)])
def test_backoff_table(spark, n, expected):
    df = spark.createDataFrame([(n,)], "n int")
    assert df.select(RT.backoff_delay(F.col("n"), [1, 2, 3, 4, 5]).alias("d")).first()["d"] == expected


def test_backoff_empty(spark):
    df = spark.createDataFrame([(3,)], "n int")
    assert df.select(RT.backoff_delay(F.col("n"), []).alias("d")).first()["d"] == 0


def test_retry_route(spark):
    f = spark.createDataFrame([(1, 10), (2, 3), (3, None), (4, 11)], "msg_id long, num_delivered int")
    out = {r["msg_id"]: (r["action"], r["delay_seconds"]) for r in RT.retry_route(f).collect()}
    assert out == {1: ("dlq", None), 2: ("retry", 60), 3: ("retry", 30), 4: ("dlq", None)}


def test_dlq_sink_and_depth(spark, tmp_dir):
    f = spark.createDataFrame([(1, 10), (2, 3)], "msg_id long, num_delivered int")
    RT.dlq_sink(RT.retry_route(f), tmp_dir + "/dlq")
    depth = RT.dlq_depth(RT.read_dlq(spark, tmp_dir + "/dlq"))
    assert depth.first()["num_messages"] == 1
    assert dlq_state(depth).first()["delta"] == "● Messages need recovery"
    empty = spark.createDataFrame([(0,)], "num_messages long")
    assert dlq_state(empty).first()["delta"] == "● Empty"


T = dt.datetime(2024, 1, 1)
AUTH = log_row(T, "auth-service", "INFO", 9, "Auth info log", "1" * 32, "1" * 16)
PAY = log_row(T + dt.timedelta(seconds=1), "payment-service", "ERROR", 17, "Payment error log", "2" * 32, "2" * 16)


@pytest.mark.parametrize("kw,expected", [
    (dict(services=["auth-service"]), ["auth-service"]),
    (dict(severities=["error"]), ["payment-service"]),
    (dict(term="Auth"), ["auth-service"]),
    (dict(), ["auth-service", "payment-service"]),
    (dict(severities=["debug"]), []),
    (dict(term="  PAYMENT "), ["payment-service"]),
    (dict(term="%"), []),
])
def test_live_filters(spark, kw, expected):
    df = L.live_tail_filter(logs_df(spark, [AUTH, PAY]), **kw)
    assert sorted(r["service_name"] for r in df.collect()) == expected


def test_live_buffer_keeps_newest_arrivals(spark):
    rows = [log_row(T + dt.timedelta(seconds=(i * 7) % 400), "svc", "WARN3", 13, f"m{i}", f"{i:032d}", "0" * 16)
            for i in range(400)]
    df = logs_df(spark, rows).withColumn("arrival_seq", F.col("trace_id").cast("long"))
    view = L.live_tail_view(df, "arrival_seq", severities=["warn"]).collect()
    assert len(view) == 15
    seqs = [r["arrival_seq"] for r in view]
    assert min(seqs) >= 100
    ts = [r["ts"] for r in view]
    assert ts == sorted(ts, reverse=True)


@pytest.mark.parametrize("text,norm,table", [
    ("WARN3", "warn", "info"), ("WARNING", "warn", "warn"), ("DEBUG2", "debug", "info"), ("", "info", "info"),
    (None, "info", "info"), ("Fatal", "fatal", "fatal"), ("notice", "info", "info"), ("trace", "trace", "trace")])
def test_severity_normalise(spark, text, norm, table):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(severity_normalise("t").alias("a"), severity_normalise("t", strip_digits=False).alias("b")).first()
    assert (r["a"], r["b"]) == (norm, table)


def test_severity_band(spark):
    df = spark.createDataFrame([(n,) for n in (0, 5, 8, 9, 13, 17, 21, 24, 25)], "n int")
    got = [r["b"] for r in df.select(severity_band("n").alias("b")).collect()]
    assert got == [None, "DEBUG", "DEBUG", "INFO", "WARNING", "ERROR", "FATAL", "FATAL", None]


def test_body_hits(spark):
    df = spark.createDataFrame([("Error: an ERROR occurred (error)",)], "b string")
    parts, hits = body_hits(F.col("b"), " error ")
    r = df.select(parts.alias("p"), hits.alias("h")).first()
    assert r["h"] == 3
    assert r["p"] == ["", "Error", ": an ", "ERROR", " occurred (", "error", ")"]
    parts2, hits2 = body_hits(F.col("b"), "(error)")
    assert df.select(hits2.alias("h")).first()["h"] == 1
    other = spark.createDataFrame([("ÉCOLE école\x00 x\\Ey",)], "b string")
    for term, want in (("école", ["", "ÉCOLE", " ", "école", "\x00 x\\Ey"]), ("X\\ey", ["ÉCOLE école\x00 ", "x\\Ey", ""]),
                       ("none", ["ÉCOLE école\x00 x\\Ey"])):
        parts3, hits3 = body_hits(F.col("b"), term)
        assert other.select(parts3.alias("p"), hits3.alias("h")).first() == (want, len(want) // 2)


@pytest.mark.parametrize("x,text", [(999, "999"), (1000, "1.00k"), (1234, "1.23k"), (12345, "12.3k"),
                                    (999999, "1.00e+3k"), (2_500_000, "2.50M"), (7.5e9, "7.50B"),
                                    (12.5, "12.5"), (0, "0"), (99960, "100k"), (999.6e9, "1.00e+3B"),
                                    (5e12, "5.00e+3B"), (1.2345e13, "1.23e+4B"), (9.996e12, "1.00e+4B"), (1e-7, "1e-7"),
                                    (2.5e-7, "2.5e-7")])
def test_short_number(spark, x, text):
    df = spark.createDataFrame([(float(x),)], "x double")
    assert df.select(short_number("x").alias("t")).first()["t"] == text


def test_cards(spark):
    stats = spark.createDataFrame([(12.0, 10.0, 1.2), (0.0, 0.0, 0.0), (5.0, 10.0, 0.5), (10.0, 10.0, 1.0)],
                                  "current_rate double, avg_rate double, ratio double")
    got = [r["delta"] for r in log_rate_card(stats).collect()]
    assert got == ["↑ 20% vs 60s avg", "No logs received in the past minute.", "↓ 50% vs 60s avg", "~ 0% vs 60s avg"]
    rates = spark.createDataFrame([(0.5,), (1.0,), (4.999,), (5.0,)], "current_rate double")
    lv = [(r["value"], r["delta"]) for r in error_level(rates).collect()]
    assert lv == [("0.50", "● Normal"), ("1.00", "● Elevated"), ("5.00", "● Elevated"), ("5.00", "● Critical")]


def test_threshold_bands(spark):
    rates = spark.createDataFrame([("a", 85.0), ("b", 60.0), ("c", 19.99), ("d", -1.0)], "service_name string, error_rate double")
    out = {r["service_name"]: (r["band_label"], r["band_colour"])
           for r in error_rate_band(rates, default_bands(spark)).collect()}
    assert out == {"a": ("Critical", "#ef5350"), "b": ("High", "#ffa726"), "c": ("Minimal", "#607d8b"),
                   "d": (None, S.DEFAULT_BAND_COLOUR)}


def test_threshold_violations(spark):
    assert threshold_violations(default_bands(spark)).count() == 0
    bad = spark.createDataFrame([(101, "#ffffff", "x"), (20, "#ffffff", " "), (20, "#fff", "y"), (10, "red", "z")],
                                "min int, colour string, label string")
    probs = sorted(r["problem"] for r in threshold_violations(bad).collect())
    assert probs == sorted(["Must be 0–100", "Duplicate value", "Duplicate value", "Invalid colour",
                            "One band must start at 0"])
    many = spark.createDataFrame([(i * 10, "#000000", f"l{i}") for i in range(9)], "min int, colour string, label string")
    assert "At most 7 bands" in [r["problem"] for r in threshold_violations(many).collect()]
    # the lookup takes any number of bands; only the editor's check counts them
    hit = error_rate_band(spark.createDataFrame([("a", 41.0)], "service_name string, error_rate double"), many).first()
    assert hit["band_label"] == "l4"


def test_due_retries(spark):
    f = spark.createDataFrame([(1, 2, "2024-01-01 00:00:00"), (2, 5, "2024-01-01 00:00:00"), (3, 10, "2024-01-01 00:00:00")],
                              "msg_id long, num_delivered int, failed_at string").withColumn("failed_at", F.col("failed_at").cast("timestamp"))
    routed = RT.retry_route(f, backoff_seconds=[5, 30, 60, 300, 3600])
    due = {r["msg_id"]: r["num_delivered"] for r in RT.due_retries(routed, "2024-01-01 00:01:00").collect()}
    assert due == {1: 3}          # 30 s passed; 5 deliveries wait 3600 s; 10 went to the DLQ
