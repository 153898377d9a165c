import datetime as dt

from pyspark.sql import functions as F

from logpond.operators import dashboards as D
from logpond.operators import rollups as R
from tests.helpers import log_row, logs_df

T0 = dt.datetime(2024, 5, 20, 10, 0, 0)


def burst(spark, service, seconds, per_second=1, sev=9):
    rows = []
    for s in seconds:
        for k in range(per_second):
            rows.append(log_row(T0 + dt.timedelta(seconds=s, milliseconds=10 * k), service, "INFO", sev,
                                "b", f"{service}-{s}-{k}".ljust(32, "0")[:32], "0" * 16))
    return rows


def test_sixty_gap_filled_points(spark):
    logs = logs_df(spark, burst(spark, "payment-service", [5, 20, 59], 2) + burst(spark, "other", [30]))
    m1s = R.metrics_1s(logs)
    s = D.ingestion_series(m1s, T0 + dt.timedelta(seconds=60, milliseconds=500))
    pay = s.filter(F.col("service_name") == "payment-service").orderBy("ts").collect()
    assert len(pay) == 60
    assert [r["logs_count"] for r in pay if r["logs_count"]] == [2, 2, 2]
    assert pay[0]["ts"].replace(tzinfo=None) == T0
    arrays = D.ingestion_series_arrays(m1s, T0 + dt.timedelta(seconds=60)).filter(
        F.col("service_name") == "payment-service").first()
    assert len(arrays["timestamps"]) == 60 and sum(arrays["counts"]) == 6
    assert arrays["timestamps"][1] - arrays["timestamps"][0] == 1000


def test_empty_window_has_no_rows(spark):
    logs = logs_df(spark, burst(spark, "a", [1]))
    assert D.ingestion_series(R.metrics_1s(logs), T0 + dt.timedelta(hours=5)).count() == 0


def test_blank_service_left_out(spark):
    logs = logs_df(spark, burst(spark, "", [1]) + burst(spark, "a", [1]))
    s = D.ingestion_series(R.metrics_1s(logs), T0 + dt.timedelta(seconds=30))
    assert {r["service_name"] for r in s.collect()} == {"a"}


def test_error_rate_and_no_logs(spark):
    logs = logs_df(spark, burst(spark, "a", range(10)) + burst(spark, "a", range(10, 15), sev=17))
    m1s = R.metrics_1s(logs)
    assert abs(D.error_rate(m1s, T0 + dt.timedelta(seconds=20)).first()["current_rate"] - 100 * 5 / 15) < 1e-9
    assert D.error_rate(m1s, T0 + dt.timedelta(hours=2)).first()["current_rate"] == 0.0


def test_log_rate_stats(spark):
    logs = logs_df(spark, burst(spark, "a", range(0, 60), 1) + burst(spark, "a", range(55, 60), 4))
    r = D.log_rate_stats(R.metrics_1s(logs), T0 + dt.timedelta(seconds=59, milliseconds=100)).first()
    # 6 buckets (54..59) enter the 5 s sum: 1*6 + 4*5
    assert r["current_rate"] == (6 + 20) / 5
    assert r["avg_rate"] == (60 + 20) / 60
    assert abs(r["ratio"] - r["current_rate"] / r["avg_rate"]) < 1e-12
    quiet = D.log_rate_stats(R.metrics_1s(logs), T0 + dt.timedelta(hours=3)).first()
    assert (quiet["current_rate"], quiet["avg_rate"], quiet["ratio"]) == (0.0, 0.0, 0.0)


def test_top_service_errors_limit_and_ties(spark):
    rows = []
    for i, svc in enumerate(["a", "b", "c", "d", "e", "f", "g"]):
        rows += burst(spark, svc, range(4), sev=9) + burst(spark, svc, [10 + (i % 3)], sev=18)
    m1m = R.metrics_1m(R.metrics_1s(logs_df(spark, rows)))
    top = D.top_service_errors(m1m, T0 + dt.timedelta(minutes=5)).collect()
    assert len(top) == 5
    assert [r["service_name"] for r in top] == ["a", "b", "c", "d", "e"]
    assert top[0]["error_rate"] == 20.0 and top[0]["total_errors"] == 1


def test_registry_first_seen_modes(spark):
    logs = logs_df(spark, burst(spark, "a", [1, 50]) + burst(spark, "b", [3])).withColumn(
        "block", (F.second("ts") >= 30).cast("int"))
    deltas = R.registry_delta(logs, "block")
    g = {r["service_name"]: r for r in R.registry_latest(deltas, "global").collect()}
    lb = {r["service_name"]: r for r in R.registry_latest(deltas, "latest_block").collect()}
    assert g["a"]["first_seen"].second == 1 and g["a"]["last_seen"].second == 50
    assert lb["a"]["first_seen"].second == 50
    assert R.distinct_services(R.registry_latest(deltas)).count() == 2


def test_compact_sums_deltas(spark):
    logs = logs_df(spark, burst(spark, "a", [1, 1, 2]))
    d1 = R.metrics_1s(logs)
    both = d1.unionByName(d1)
    c = {r["ts"].second: r["logs_count"] for r in R.metrics_compact(both).collect()}
    assert c == {1: 4, 2: 2}
