import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logpond.operators import search as Q
from logpond.sources.events_adapter import read_logs
from tests.conftest import SF_SMALL
from tests.helpers import R1, R2, R3, R4, log_row, logs_df


@pytest.fixture(scope="module")
def logs(spark):
    return logs_df(spark, [R1, R2, R3, R4]).cache()


def ids(df):
    return [r["trace_id"] for r in df.select("trace_id").collect()]


@pytest.mark.parametrize("kw,expected", [
    (dict(service_name="test-service"), 3),
    (dict(service_name="test"), 3),
    (dict(service_name="none-match"), 0),
    (dict(severity_text="WARNING"), 1),
    (dict(start="2024-05-19 00:00:00"), 4),
    (dict(start="2024-05-19 00:00:00", end="2025-01-01 00:00:00"), 2),
    (dict(body="timeout"), 1),
    (dict(trace_id="4BF92F"), 2),
    (dict(span_id="00f067aa0ba902b"), 3),
    (dict(severity_number=17), 2),
    (dict(severity_number=-1), 4),
])
def test_filter_cases(logs, kw, expected):
    f = Q.LogFilter(**kw)
    assert len(ids(Q.search_logs(logs, f))) == expected
    assert Q.search_count(logs, f).first()["total"] == expected


def test_page_order(logs):
    asc = Q.search_logs(logs, Q.LogFilter(limit=1))
    desc = Q.search_logs(logs, Q.LogFilter(limit=1, descending=True))
    assert ids(asc) == [R1["trace_id"]]
    assert ids(desc) == [R4["trace_id"]]


def test_offset_and_default_limit(logs):
    page = Q.search_logs(logs, Q.LogFilter(limit=2, offset=2))
    assert ids(page) == [R3["trace_id"], R4["trace_id"]]
    assert Q.LogFilter(limit=0).page_limit == 100
    assert Q.LogFilter(offset=-5).page_offset == 0


def test_order_by_service(logs):
    page = Q.search_logs(logs, Q.LogFilter(order_by="ServiceName"))
    assert [r["service_name"] for r in page.collect()][0] == "payment-service"


def test_wildcards_and_literal(logs):
    # '%' and '_' act as wildcards, as with the bound SQL parameter
    assert len(ids(Q.search_logs(logs, Q.LogFilter(body="due_to")))) == 2
    assert len(ids(Q.search_logs(logs, Q.LogFilter(body="due_to", literal=True)))) == 0


def api(params):
    base = {"descending": "false", "limit": "100", "offset": "0"}
    base.update(params)
    return Q.parse_search_params(base)


@pytest.mark.parametrize("params,total,rows,first", [
    ({"severityText": "WARNING"}, 1, 1, R2),
    ({"body": "timeout"}, 1, 1, R1),
    ({"limit": "2"}, 4, 2, R1),
    ({"limit": "2", "offset": "2"}, 4, 2, R3),
    ({"startTime": "2024-05-19T00:00:00", "endTime": "2025-01-01T00:00:00"}, 2, 2, R1),
    ({"orderBy": "timestamp", "descending": "true"}, 4, 4, R4),
])
def test_api_cases(logs, params, total, rows, first):
    f = api(params)
    doc = json.loads(Q.search_json(logs, f).first()["json"])
    assert doc["meta"]["totalRowCount"] == total
    assert len(doc["data"]) == rows
    assert doc["data"][0]["traceId"] == first["trace_id"]


def test_json_record_shape(logs):
    doc = json.loads(Q.search_json(logs, api({"body": "timeout"})).first()["json"])
    rec = doc["data"][0]
    assert rec["logAttributes"][1] == {"key": "http.status_code", "value": "504"}
    assert rec["resourceAttributes"] == [{"key": "service.name", "value": "test-service"}]
    assert rec["bodyType"] == "string"


@pytest.mark.parametrize("bad", [
    {"limit": "ten"}, {"offset": "x"}, {"startTime": "2024-05-19"}, {"endTime": "yesterday"},
    {"descending": "maybe"}, {"severityNumber": "high"},
])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        api(bad)


def test_missing_mandatory():
    with pytest.raises(ValueError):
        Q.parse_search_params({"limit": "1", "offset": "0"})


def test_unknown_order_field_falls_back():
    assert api({"orderBy": "timestamp"}).order_by == "Timestamp"
    assert api({"orderBy": "ServiceName"}).order_by == "ServiceName"


def test_partition_filter_in_plan(spark, tmp_dir, logs):
    from logpond.operators import storage as ST
    path = tmp_dir + "/logs"
    ST.write_logs(logs, path)
    t = ST.read_logs_table(spark, path)
    q = Q.apply_filter(t, Q.LogFilter(start="2024-05-19 00:00:00", end="2024-05-24 00:00:00"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    assert q.count() == 2


def test_unflatten_and_live_zip(spark):
    from pyspark.sql import functions as F
    from logpond.functions.values import live_tail_attrs, unflatten_attrs
    df = spark.createDataFrame([(["a", "b", "c"], ["1"]), (None, ["x"]), (["k"], ["v", "extra"])],
                               "k array<string>, v array<string>")
    got = [r["u"] for r in df.select(unflatten_attrs("k", "v").alias("u")).collect()]
    assert [[tuple(x) for x in g] for g in got] == [[("a", "1"), ("b", ""), ("c", "")], [], [("k", "v")]]
    live = [r["u"] for r in df.select(live_tail_attrs("k", "v").alias("u")).collect()]
    assert [[tuple(x) for x in g] for g in live] == [[("a", "1"), ("b", None), ("c", None)], [], [("k", "v")]]


def walk(logs, f):
    token, out = None, []
    while True:
        page = Q.search_page(logs, f, token).collect()
        if not page:
            return out
        assert len(page) <= f.page_limit
        out.append(page)
        token = Q.next_token(page, token)


def _same(rows):
    return sorted(str(r.asDict()) for r in rows)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("order_by", ["Timestamp", "ServiceName"])
@pytest.mark.parametrize("unique", [False, True])
def test_pages_reach_every_row_once(spark, order_by, descending, unique):
    """Equal ids, equal times, rows equal in all columns, nulls in the keys."""
    logs = read_logs(spark, SF_SMALL).where("event_id < 120")
    same = logs.withColumn("trace_id", F.lit("0" * 32)).withColumn("span_id", F.lit("0" * 16)).withColumn(
        "ts", F.when(F.col("event_id") % 4 == 0, F.lit("2024-01-01").cast("timestamp"))
        .when(F.col("event_id") % 4 == 1, F.lit("2024-01-02").cast("timestamp"))
        .when(F.col("event_id") % 4 == 2, F.col("ts"))).withColumn("ts_nanos", F.unix_micros("ts") * 1000).withColumn(
        "service_name", F.when(F.col("event_id") % 3 > 0, F.lit("svc-0")).when(F.col("event_id") % 2 == 0, F.lit("svc-1")))
    if not unique:
        # rows that share everything, nine of them at a time
        same = same.drop("event_id").withColumn("body", F.lit("b")).withColumn("log_attr_values", F.array(F.lit("v")))
        same = same.select("*", F.explode(F.array(*[F.lit(k) for k in range(3)]))).drop("col")
    same = same.repartition(4)
    f = Q.LogFilter(order_by=order_by, descending=descending, limit=7)
    pages = walk(same, f)
    rows = [r for p in pages for r in p]
    assert _same(rows) == _same(same.withColumn("page_key", Q.page_key(same, f)).collect())
    first = [r["ts" if order_by == "Timestamp" else "service_name"] for r in rows]
    known = [x for x in first if x is not None]
    nulls = [None] * (len(first) - len(known))
    assert first == (sorted(known, reverse=True) + nulls if descending else nulls + sorted(known))
    assert {len(p) for p in pages[:-1]} == {7}


@pytest.mark.parametrize("descending", [False, True])
def test_pages_by_key_equal_pages_by_offset(spark, descending):
    rows = [log_row(dt.datetime(2024, 1, 1, 0, 0, i // 20), "s", "INFO", 9, str(i), f"{(i * 7) % 100:032d}", "0" * 16) for i in range(100)]
    for i, r in enumerate(rows):
        r["ts_nanos"] = 1704067200 * 10 ** 9 + i // 20 * 10 ** 9 + (i * 13) % 5      # below the microsecond
    logs = logs_df(spark, rows)
    whole = [r["body"] for r in Q.search_logs(logs, Q.LogFilter(limit=100, descending=descending)).collect()]
    want = sorted(range(100), key=lambda i: (rows[i]["ts_nanos"], rows[i]["trace_id"]), reverse=descending)
    assert whole == [str(i) for i in want]
    assert [r["body"] for p in walk(logs, Q.LogFilter(limit=30, descending=descending)) for r in p] == whole


def test_service_prefix_through_the_registry(spark, tmp_dir):
    from logpond.operators import rollups as R
    logs = read_logs(spark, SF_SMALL)
    registry = R.registry_delta(logs)
    logs.write.parquet(tmp_dir + "/logs")
    stored = spark.read.parquet(tmp_dir + "/logs")
    for prefix in ("SVC-1", "svc", "s_c-2", "none", "svc-1%"):
        f = Q.LogFilter(service_name=prefix)
        pruned = Q.apply_filter(stored, f, registry)
        assert _same(pruned.collect()) == _same(Q.apply_filter(stored, f).collect())
    plan = Q.apply_filter(stored, Q.LogFilter(service_name="SVC-1"), registry)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(service_name,svc-1)" in plan or "In(service_name" in plan


def test_id_prefix_is_pushed(spark, tmp_dir):
    rows = [log_row(dt.datetime(2024, 1, 1), "s", "INFO", 9, str(i), f"{i:032x}", f"{i:016x}") for i in range(300)]
    logs_df(spark, rows).write.parquet(tmp_dir + "/ids")
    logs = spark.read.parquet(tmp_dir + "/ids")
    for value in (f"{255:032x}", f"{255:032X}", "0" * 30 + "F", "0" * 29 + "12", "0%f", "zz"):
        got = sorted(r["body"] for r in Q.apply_filter(logs, Q.LogFilter(trace_id=value)).collect())
        like = sorted(r["body"] for r in logs.filter(F.col("trace_id").ilike(value + "%")).collect())
        assert got == like
    found = Q.apply_filter(logs, Q.LogFilter(trace_id="12")).select("body")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = found._jdf.queryExecution().explainString(mode)
    assert "GreaterThanOrEqual(trace_id" in plan and "LessThan(trace_id" in plan
