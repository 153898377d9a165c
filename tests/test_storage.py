import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logpond.operators import storage as ST
from logpond.operators.prefix import running_sum_desc
from tests.helpers import log_row, logs_df


def parts_df(spark, sizes):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), b) for i, b in enumerate(sizes)]
    return spark.createDataFrame(rows, "log_date date, partition_bytes bigint")


@pytest.mark.parametrize("sizes,steady,projected", [
    ([], False, 0),
    ([700], False, 700 * 30),
    ([100, 999], False, 100 * 30),
    ([100, 201, 50], False, ((100 + 201) // 2) * 30),
    ([10] * 30, True, 300),
    ([10] * 31, True, 310),
])
def test_storage_outlook_cases(spark, sizes, steady, projected):
    df = parts_df(spark, sizes) if sizes else spark.createDataFrame([], "log_date date, partition_bytes bigint")
    r = ST.storage_outlook(df).first()
    assert r["is_steady_state"] == steady
    assert r["projected_steady_state_bytes"] == projected
    assert r["days_of_history"] == len(sizes)
    assert r["current_total_bytes"] == sum(sizes)


def test_disk_usage_and_runway(spark):
    disks = spark.createDataFrame([("default", 600, 1000), ("zz", 1, 2)], "disk_name string, free_bytes bigint, total_bytes bigint")
    assert ST.disk_usage(disks).orderBy("disk_name").first()["used_percent"] == 40.0
    stable = ST.storage_runway(disks, spark.createDataFrame([(400,)], "projected_steady_state_bytes bigint")).first()
    assert (stable["value"], stable["delta"]) == ("40", "Stable")
    warn = ST.storage_runway(disks, spark.createDataFrame([(430,)], "projected_steady_state_bytes bigint")).first()
    assert warn["delta"] == "~600 days at current rate" and warn["level"] == "growing"
    act = ST.storage_runway(disks, spark.createDataFrame([(10400,)], "projected_steady_state_bytes bigint")).first()
    assert act["delta"] == "~2 days — action needed"


def test_sink_roundtrip_and_load_if_empty(spark, tmp_dir):
    rows = [log_row(dt.datetime(2024, 1, 1 + i % 3, 1), f"s{i % 2}", "INFO", 9, f"b{i}", f"{i:032d}", f"{i:016d}")
            for i in range(20)]
    df = logs_df(spark, rows)
    path = tmp_dir + "/t"
    assert ST.load_if_empty(spark, path, df) is True
    assert ST.load_if_empty(spark, path, df) is False
    back = ST.read_logs_table(spark, path)
    assert back.count() == 20
    assert sorted(r["body"] for r in back.collect()) == sorted(r["body"] for r in rows)
    assert back.filter(F.col("inserted_at").isNull()).count() == 0
    disk = ST.partition_bytes_on_disk(spark, path).collect()
    assert len(disk) == 3 and all(r["partition_bytes"] > 0 for r in disk)


def test_validate_ids(spark):
    good = log_row(dt.datetime(2024, 1, 1), "s", "INFO", 9, "b", "a" * 32, "b" * 16)
    bad = log_row(dt.datetime(2024, 1, 1), "s", "INFO", 9, "b", "a" * 31, "b" * 16)
    df = logs_df(spark, [good, bad])
    with pytest.raises(ValueError):
        ST.validate_ids(df, strict=True)
    ok, rej = ST.validate_ids(df, strict=False)
    assert (ok.count(), rej.count()) == (1, 1)
    assert ST.validate_ids(logs_df(spark, [good]), strict=True)[0].count() == 1
    assert ST.id_check_counts(df).first().asDict() == {"valid": 1, "invalid": 1}


def test_apply_retention(spark, tmp_dir):
    rows = [log_row(dt.datetime(2024, 1, d, h), "s", "INFO", 9, f"{d}-{h}", f"{d:016d}{h:016d}", "0" * 16)
            for d in range(1, 11) for h in (0, 12)]
    path = tmp_dir + "/ret"
    ST.write_logs(logs_df(spark, rows), path)
    res = ST.apply_retention(spark, path, "2024-01-10 06:00:00", "5 days")
    assert sorted(res["dropped_days"]) == [f"2024-01-0{d}" for d in range(1, 5)]
    view = ST.retention_view(ST.read_logs_table(spark, path), "2024-01-10 06:00:00", "5 days")
    left = sorted(r["body"] for r in view.collect())
    expected = sorted(f"{d}-{h}" for d in range(1, 11) for h in (0, 12)
                      if dt.datetime(2024, 1, d, h) > dt.datetime(2024, 1, 5, 6))
    assert left == expected


def test_running_sum_matches_brute_force(spark):
    rnd = random.Random(7)
    # a third of the rows share one timestamp (hot key); ids break ties
    rows = [(i, dt.datetime(2024, 1, 1, 0, 0, 0) if i % 3 == 0 else dt.datetime(2024, 1, 1, 0, rnd.randint(0, 59)),
             rnd.randint(1, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, size long")
    got = {r["id"]: r["running"] for r in running_sum_desc(df, ["ts", "id"], "size", num_partitions=6).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)
    acc, want = 0, {}
    for i, _, s in order:
        acc += s
        want[i] = acc
    assert got == want


def test_retention_bytes_matches_brute_force(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 31)
    rows = [(i, base - dt.timedelta(seconds=rnd.randint(0, 20 * 3600)), rnd.randint(1, 100)) for i in range(2000)]
    df = spark.createDataFrame(rows, "msg_id long, received_at timestamp, size long")
    for cap in (0, 50, 5000, 10 ** 9):
        got = sorted(r["msg_id"] for r in ST.retention_bytes(df, base, "12 hours", cap).collect())
        young = sorted([r for r in rows if r[1] > base - dt.timedelta(hours=12)], key=lambda r: (r[1], r[0]), reverse=True)
        acc, want = 0, []
        for i, _, s in young:
            acc += s
            if acc <= cap:
                want.append(i)
        assert got == sorted(want), cap


def test_retention_on_queue_samples(spark, tmp_dir):
    from logpond.operators import queue as QU
    rows = [(dt.datetime(2024, 1, d, h), "w", "LOGS", 0, 0, d * 100 + h) for d in (1, 2, 3) for h in (1, 13)]
    samples = spark.createDataFrame(rows, "ts timestamp, consumer_name string, stream_name string, "
                                          "num_ack_pending long, num_redelivered long, num_pending long")
    path = tmp_dir + "/qs"
    QU.append_samples(samples, path)
    res = ST.apply_retention(spark, path, "2024-01-03 02:00:00", "1 day", date_col="sample_date")
    assert res == {"dropped_days": ["2024-01-01"]}
    left = sorted(r["num_pending"] for r in QU.read_samples(spark, path).collect())
    assert left == [201, 213, 301, 313]
    view = ST.retention_view(QU.read_samples(spark, path), "2024-01-03 02:00:00", "1 day")
    assert sorted(r["num_pending"] for r in view.collect()) == [213, 301, 313]


def test_running_sum_with_payload_and_hot_second(spark):
    n = 400_000
    t = F.when(F.col("id") % 3 == 0, F.lit("2024-01-01 00:00:30")).otherwise(
        F.concat(F.lit("2024-01-01 00:"), F.lpad((F.col("id") % 60).cast("string"), 2, "0"), F.lit(":00"))).cast("timestamp")
    df = spark.range(0, n, 1, 7).select("id", t.alias("ts"), F.lit(1).alias("size"), F.repeat(F.lit("x"), 50).alias("payload"))
    got = running_sum_desc(df, ["ts", "id"], "size", num_partitions=16)
    r = got.agg(F.countDistinct("running").alias("d"), F.min("running").alias("lo"), F.max("running").alias("hi")).first()
    assert (r["d"], r["lo"], r["hi"]) == (n, 1, n)
    wrong = got.selectExpr("*", "lead(running) OVER (PARTITION BY ts ORDER BY id DESC) - running AS step").where("step <> 1")
    assert wrong.count() == 0


def test_runway_rounds_half_to_even(spark):
    disks = spark.createDataFrame([("d", 750, 1000), ], "disk_name string, free_bytes bigint, total_bytes bigint")
    out = ST.storage_runway(disks, spark.createDataFrame([(100,)], "projected_steady_state_bytes bigint")).first()
    assert out["value"] == "25"      # 25.0 exactly
    disks2 = spark.createDataFrame([("d", 875, 1000)], "disk_name string, free_bytes bigint, total_bytes bigint")
    out2 = ST.storage_runway(disks2, spark.createDataFrame([(100,)], "projected_steady_state_bytes bigint")).first()
    assert out2["value"] == "12"     # 12.5 -> 12, as %.0f prints it
