import os

import pytest
from pyspark.sql import functions as F

from logpond.operators import rollups as R
from logpond.plans.q_decode import _requests
from logpond.sources.envelopes import envelopes_to_logs, read_envelopes, to_envelopes
from logpond.sources.events_adapter import read_logs
from logpond.streaming import commits as C
from logpond.streaming import ingest as I
from logpond.streaming import livetail as LT
from tests.conftest import SF_SMALL


def _envelopes(spark, path):
    b = F.col("batch_id")
    ct = F.when(b % 2 == 0, F.lit("application/json")).otherwise(F.lit("application/x-protobuf"))
    enc = F.element_at(F.array(F.lit(""), F.lit("gzip"), F.lit("zstd")), (b % 3 + 1).cast("int"))
    to_envelopes(_requests(spark, SF_SMALL), ct, enc).repartitionByRange(3, "batch_id").write.parquet(path)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_batch_and_replay_is_idempotent(spark, tmp_dir):
    src, out = tmp_dir + "/src", tmp_dir + "/out"
    _envelopes(spark, src)
    q = I.start_ingest(spark, src, out, available_now=True, max_files_per_trigger=1)
    assert q.awaitTermination(300)
    assert q.lastProgress is not None
    stream_logs = I.read_stream_logs(spark, out)
    batch_logs, _ = envelopes_to_logs(read_envelopes(spark, src))
    cols = ["trace_id", "span_id", "ts_nanos", "service_name", "body", "severity_number"]
    assert _rows(stream_logs.select(cols)) == _rows(batch_logs.select(cols))
    m_stream = I.read_metrics(spark, out, "1s")
    m_batch = R.metrics_1s(read_logs(spark, SF_SMALL))
    assert _rows(m_stream) == _rows(m_batch)
    # a replayed batch id carries the same input (same offsets): running it
    # twice must leave one copy of its output
    replay = I.IngestPaths(tmp_dir + "/replay")
    part = read_envelopes(spark, src).filter(F.col("batch_id") < 4)
    I.process_batch(part, 7, replay)
    once = (I.read_stream_logs(spark, replay.root).count(), _rows(I.read_metrics(spark, replay.root)))
    I.process_batch(part, 7, replay)
    twice = (I.read_stream_logs(spark, replay.root).count(), _rows(I.read_metrics(spark, replay.root)))
    assert once == twice and once[0] == 400
    # a table without its checkpoint is not taken for a new stream's
    with pytest.raises(RuntimeError):
        I.start_ingest(spark, src, replay.root)
    # a restart finds nothing new
    q2 = I.start_ingest(spark, src, out, available_now=True, max_files_per_trigger=1)
    assert q2.awaitTermination(300)
    assert _rows(I.read_metrics(spark, out, "1m")) == _rows(R.metrics_1m(R.metrics_1s(read_logs(spark, SF_SMALL))))


def test_windowed_variant_has_watermark(spark, tmp_dir):
    src = tmp_dir + "/w"
    read_logs(spark, SF_SMALL).write.parquet(src)
    stream = spark.readStream.schema(read_logs(spark, SF_SMALL).schema).parquet(src)
    agg = I.windowed_metrics_1s(stream)
    assert agg.isStreaming
    q = (agg.writeStream.outputMode("append").format("memory").queryName("w1s")
         .trigger(availableNow=True).start())
    assert q.awaitTermination(300)
    got = spark.sql("SELECT sum(logs_count) AS n FROM w1s").first()["n"]
    # append mode emits closed windows only: all but the last few seconds
    assert 0 < got <= read_logs(spark, SF_SMALL).count()


def _run(spark, src, out):
    assert I.start_ingest(spark, src, out, available_now=True, max_files_per_trigger=1).awaitTermination(300)


COLS = ["trace_id", "span_id", "ts_nanos", "service_name", "body"]


def _state(spark, out):
    return (_rows(I.read_stream_logs(spark, out).select(COLS)), _rows(I.read_metrics(spark, out, "1s")),
            _rows(I.read_metrics(spark, out, "1m")), _rows(I.read_registry(spark, out)),
            [r["trace_id"] for r in I.read_stream_logs(spark, out).orderBy("arrival_seq").collect()])


def test_compaction_and_vacuum_keep_results(spark, tmp_dir):
    src, out = tmp_dir + "/src", tmp_dir + "/out"
    _envelopes(spark, src)
    _run(spark, src, out)
    before = _state(spark, out)
    days = [d.split("=", 1)[1] for d in os.listdir(I.IngestPaths(out).logs) if d.startswith("log_date=")]
    for _ in range(2):                                   # a merged part can be merged again
        I.compact_logs(spark, out, days)
        for kind in I.KINDS:
            I.compact_deltas(spark, out, kind)
        assert _state(spark, out) == before
    assert I.vacuum(spark, out) > 0
    assert _state(spark, out) == before
    assert I.vacuum(spark, out) == 0
    for day in days:                                     # one attempt is left in each day
        assert len([d for d in os.listdir(f"{I.IngestPaths(out).logs}/log_date={day}") if d.startswith("attempt=")]) == 1
    # later batches come on top of the merged parts
    more = read_envelopes(spark, src).filter(F.col("batch_id") < 2)
    I.process_batch(more, 100_000, I.IngestPaths(out))
    assert len(_state(spark, out)[0]) == len(before[0]) + 200
    assert _state(spark, out)[4][:len(before[4])] == before[4]
    I.compact_logs(spark, out, days)
    assert _state(spark, out)[4][:len(before[4])] == before[4]


def test_maintenance_that_dies_changes_nothing(spark, tmp_dir, monkeypatch):
    src, out = tmp_dir + "/src", tmp_dir + "/out"
    _envelopes(spark, src)
    _run(spark, src, out)
    before = _state(spark, out)
    days = [d.split("=", 1)[1] for d in os.listdir(I.IngestPaths(out).logs) if d.startswith("log_date=")]
    commit = C.commit_parts

    def dying(*a):
        raise OSError("died before the commit")

    monkeypatch.setattr(C, "commit_parts", dying)
    for job in (lambda: I.compact_logs(spark, out, days), lambda: I.compact_deltas(spark, out, "metrics_1s")):
        with pytest.raises(OSError):
            job()
        assert _state(spark, out) == before
    monkeypatch.setattr(C, "commit_parts", commit)
    assert I.vacuum(spark, out) > 0                      # what the dead jobs had written
    assert _state(spark, out) == before


def test_delta_compaction_with_ttl(spark, tmp_dir):
    src, out = tmp_dir + "/src", tmp_dir + "/out"
    _envelopes(spark, src)
    _run(spark, src, out)
    m = I.read_metrics(spark, out, "1s")
    cutoff_row = m.orderBy("ts").collect()[len(m.collect()) // 2]
    as_of = cutoff_row["ts"].replace(tzinfo=None) + __import__("datetime").timedelta(hours=1)
    expected = _rows(m.filter(F.col("ts") > F.lit(cutoff_row["ts"])))
    I.compact_deltas(spark, out, "metrics_1s", as_of.isoformat(sep=" "), "1 hour")
    assert _rows(I.read_metrics(spark, out, "1s")) == expected


def test_batch_with_bad_payload_writes_quarantine(spark, tmp_dir):
    src = tmp_dir + "/src"
    _envelopes(spark, src)
    env = read_envelopes(spark, src).filter(F.col("batch_id") < 3)
    bad = env.limit(1).withColumn("batch_id", F.lit(999).cast("bigint")) \
        .withColumn("payload", F.lit(b"{not json").cast("binary")) \
        .withColumn("content_type", F.lit("application/json")).withColumn("content_encoding", F.lit(""))
    paths = I.IngestPaths(tmp_dir + "/out")
    I.process_batch(env.unionByName(bad), 3, paths)
    q = I.read_quarantine(spark, paths.root).collect()
    assert len(q) == 1 and q[0]["error"] == "invalid json payload" and q[0]["batch_id"] == 3
    assert I.read_stream_logs(spark, paths.root).count() == 300
    I.process_batch(env.unionByName(bad), 3, paths)   # replay: still one copy
    assert I.read_quarantine(spark, paths.root).count() == 1
    assert q[0]["payload"] == b"{not json" and q[0]["content_type"] == "application/json"


def test_replay_on_another_day_leaves_one_copy(spark, tmp_dir):
    """Records without a time take the envelope's arrival time, so a second
    attempt of a batch, whenever it runs, writes to the same day."""
    import json
    rec = {"severityNumber": 9, "severityText": "INFO", "body": {"stringValue": "b"}}
    payload = json.dumps({"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [rec] * 12}]}]})
    env = spark.createDataFrame([(1, payload.encode(), "application/json", "", 1, "2024-03-05 23:59:59")],
                                "batch_id long, payload binary, content_type string, content_encoding string, "
                                "num_delivered int, received_at string").withColumn("received_at", F.col("received_at").cast("timestamp"))
    paths = I.IngestPaths(tmp_dir + "/out")
    for _ in range(2):
        I.process_batch(env, 5, paths)
    logs = I.read_stream_logs(spark, paths.root)
    assert logs.count() == 12
    assert [str(r[0]) for r in logs.select("log_date").distinct().collect()] == ["2024-03-05"]
    assert I.read_metrics(spark, paths.root).agg(F.sum("logs_count")).first()[0] == 12


@pytest.mark.parametrize("failing", ["rows", "rollups", "retries", "dlq", "commit"])
def test_a_failure_after_each_write_job(spark, tmp_dir, monkeypatch, failing):
    """Whatever job of a batch fails, before or after it has written: readers
    see none of that attempt, and after the retry each record is there once,
    in every table."""
    src = tmp_dir + "/src"
    _envelopes(spark, src)
    env = read_envelopes(spark, src).filter(F.col("batch_id") < 4)
    bad = env.limit(1).withColumn("batch_id", F.lit(99).cast("bigint")).withColumn("payload", F.lit(b"x").cast("binary"))
    paths = I.IngestPaths(tmp_dir + "/out")
    append, commit = C.append, C.commit
    broken = {"on": True}

    def append_then_fail(rows, root, table, attempt, *parts):
        append(rows, root, table, attempt, *parts)
        stores = table == failing or (table == "rollups" and failing in ("retries", "dlq"))
        if broken["on"] and stores:
            raise OSError(f"lost after {table}")

    def commit_fails(*a, **k):
        if broken["on"] and failing == "commit":
            raise OSError("lost before the commit")
        commit(*a, **k)

    monkeypatch.setattr(C, "append", append_then_fail)
    monkeypatch.setattr(C, "commit", commit_fails)
    ends = failing in ("retries", "dlq", "commit")           # the query itself fails, the batch is replayed
    try:
        I.process_batch(env.unionByName(bad), 1, paths, "2024-01-01 00:00:00")
        assert not ends
    except OSError:
        assert ends
    assert I.read_stream_logs(spark, paths.root).count() == 0
    assert _rows(I.read_metrics(spark, paths.root)) == [] and I.read_quarantine(spark, paths.root).count() == 0
    broken["on"] = False
    I.process_batch(env.unionByName(bad), 1, paths, "2024-01-01 00:00:01")      # the replay
    I.process_batch(env.limit(0), 2, paths, "2024-01-01 02:00:00")              # takes due retries
    I.process_batch(env.limit(0), 3, paths, "2024-01-01 04:00:00")
    logs = I.read_stream_logs(spark, paths.root)
    assert logs.count() == logs.select("trace_id").distinct().count() == 400
    assert I.read_metrics(spark, paths.root).agg(F.sum("logs_count")).first()[0] == 400
    assert I.read_metrics(spark, paths.root, "1m").agg(F.sum("logs_count")).first()[0] == 400
    assert I.read_quarantine(spark, paths.root).count() == 1
    assert I.read_dead_letters(spark, paths.root).count() == 0
    I.vacuum(spark, paths.root)
    assert I.read_stream_logs(spark, paths.root).count() == 400


def test_one_bad_payload_does_not_decode_the_batch_twice(spark, tmp_dir, monkeypatch):
    from logpond.sources.otlp_json import decode_requests
    src = tmp_dir + "/src"
    _envelopes(spark, src)
    env = read_envelopes(spark, src).filter(F.col("batch_id") < 6)
    n = env.count()
    bad = env.limit(1).withColumn("batch_id", F.lit(99).cast("bigint")).withColumn("payload", F.lit(b"x").cast("binary"))
    calls = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(I, "decode_envelopes", lambda e: decode_requests(e, on_payload=lambda: calls.add(1)))
    I.process_batch(env.unionByName(bad), 1, I.IngestPaths(tmp_dir + "/out"))
    assert I.read_quarantine(spark, tmp_dir + "/out").count() == 1
    assert 0 < calls.value <= n + 1


def test_retention_on_the_streams_own_table(spark, tmp_dir):
    from logpond.operators import storage as ST
    src, out = tmp_dir + "/src", tmp_dir + "/out"
    _envelopes(spark, src)
    _run(spark, src, out)
    logs = I.read_stream_logs(spark, out)
    first = logs.agg(F.min("ts")).first()[0].replace(tzinfo=None)
    as_of = (first + __import__("datetime").timedelta(days=1, seconds=60)).isoformat(sep=" ")
    want = _rows(ST.retention_view(logs, as_of, "1 day").select(COLS))
    n = logs.count()
    assert 0 < len(want) < n
    assert I.expire_logs(spark, out, as_of, "1 day") == [first.date().isoformat()]      # inside the edge day
    assert _rows(I.read_stream_logs(spark, out).select(COLS)) == want
    late = (first + __import__("datetime").timedelta(days=9)).isoformat(sep=" ")
    I.expire_logs(spark, out, late, "1 day")                                            # whole days
    assert I.read_stream_logs(spark, out).count() == 0
    assert I.vacuum(spark, out) > 0 and not [
        d for d in os.listdir(f"{I.IngestPaths(out).logs}/log_date={first.date()}") if d.startswith("attempt=")]


def test_failed_writes_are_retried_then_dead(spark, tmp_dir, monkeypatch):
    src = tmp_dir + "/src"
    _envelopes(spark, src)
    env = read_envelopes(spark, src)
    a, b = env.filter(F.col("batch_id") < 2), env.filter((F.col("batch_id") >= 2) & (F.col("batch_id") < 5))
    old = env.filter(F.col("batch_id") == 7).withColumn("num_delivered", F.lit(10))
    paths = I.IngestPaths(tmp_dir + "/out")
    write = I.write_batch
    monkeypatch.setattr(I, "write_batch", lambda *x: (_ for _ in ()).throw(OSError("no store")))
    for _ in range(2):                                                # replayed: stored once
        I.process_batch(a.unionByName(old), 1, paths, "2024-01-01 00:00:00")
    dead = I.read_dead_letters(spark, paths.root).collect()
    assert len(dead) == 1 and "no store" in dead[0]["failure_reason"]  # tenth delivery
    assert dead[0]["payload"] == old.first()["payload"]
    monkeypatch.setattr(I, "write_batch", write)
    I.process_batch(b, 2, paths, "2024-01-01 00:00:02")               # not yet due
    assert I.read_stream_logs(spark, paths.root).count() == 300
    c = env.filter(F.col("batch_id") == 5)
    for _ in range(2):                                                # due; replayed with the same claim
        I.process_batch(c, 3, paths, "2024-01-01 00:01:00")
        assert I.read_stream_logs(spark, paths.root).count() == 300 + 200 + 100
    I.process_batch(env.filter(F.col("batch_id") == 6), 4, paths, "2024-01-01 00:02:00")
    assert I.read_stream_logs(spark, paths.root).count() == 700       # taken once
    assert I.read_metrics(spark, paths.root).agg(F.sum("logs_count")).first()[0] == 700


def test_retries_run_out(spark, tmp_dir, monkeypatch):
    src = tmp_dir + "/src"
    _envelopes(spark, src)
    env = read_envelopes(spark, src)
    one, none = env.filter(F.col("batch_id") == 0).withColumn("num_delivered", F.lit(8)), env.filter(F.lit(False))
    paths = I.IngestPaths(tmp_dir + "/out")
    monkeypatch.setattr(I, "write_batch", lambda *x: (_ for _ in ()).throw(OSError("no store")))
    for k, at in enumerate(["00:00:00", "02:00:00", "04:00:00", "06:00:00"]):
        I.process_batch(one if k == 0 else none, k, paths, f"2024-01-01 {at}")
    dead = I.read_dead_letters(spark, paths.root).collect()
    assert len(dead) == 1 and dead[0]["num_delivered"] == 10


def test_claims_of_a_batch_that_dies(spark, tmp_dir, monkeypatch):
    """A batch takes due retries and dies before its commit: its claim does
    not count, the replay takes them; two batches never both do."""
    src = tmp_dir + "/src"
    _envelopes(spark, src)
    env = read_envelopes(spark, src)
    paths = I.IngestPaths(tmp_dir + "/out")
    write, commit = I.write_batch, C.commit
    monkeypatch.setattr(I, "write_batch", lambda *x: (_ for _ in ()).throw(OSError("no store")))
    I.process_batch(env.filter("batch_id < 2"), 1, paths, "2024-01-01 00:00:00")
    monkeypatch.setattr(I, "write_batch", write)
    monkeypatch.setattr(C, "commit", lambda *x: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        I.process_batch(env.filter("batch_id = 2"), 2, paths, "2024-01-01 01:00:00")
    monkeypatch.setattr(C, "commit", commit)
    assert I.read_stream_logs(spark, paths.root).count() == 0
    I.process_batch(env.filter("batch_id = 2"), 2, paths, "2024-01-01 01:00:05")
    I.process_batch(env.filter("batch_id = 3"), 3, paths, "2024-01-01 05:00:00")
    logs = I.read_stream_logs(spark, paths.root)
    assert logs.count() == logs.select("trace_id").distinct().count() == 400


def test_live_tail_over_ingested_rows(spark, tmp_dir):
    src, out = tmp_dir + "/src", tmp_dir + "/out"
    _envelopes(spark, src)
    _run(spark, src, out)
    logs = I.read_stream_logs(spark, out)
    last = [r["trace_id"] for r in logs.orderBy(F.col("arrival_seq").desc()).limit(50).collect()]
    assert logs.select("arrival_seq").distinct().count() == logs.count()
    seen = []
    q = LT.start_live_tail(spark, out, tmp_dir + "/tail_ckpt", lambda df: seen.append([r["trace_id"] for r in df.collect()]), 50)
    assert q.awaitTermination(300)
    assert set(seen[-1]) == set(last)
    assert {r["trace_id"] for r in LT.live_view(spark, out, 50, rows=50).collect()} == set(last)
    # the same after compaction, and only the last batches' folders are read
    days = [str(r[0]) for r in logs.select("log_date").distinct().collect()]
    I.compact_logs(spark, out, days)
    assert {r["trace_id"] for r in LT.ring(spark, out, 50).collect()} == set(last)
    I.process_batch(read_envelopes(spark, src).filter("batch_id = 0"), 50, I.IngestPaths(out))
    newest = I.newest_rows(spark, out, 50)
    assert {r["batch_id"] for r in newest.select("batch_id").distinct().collect()} == {50}
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(attempt" in plan and "substring(attempt" in plan
    assert LT.ring(spark, tmp_dir + "/nothing", 50).count() == 0


def test_body_index_loses_no_row_and_skips_files(spark, tmp_dir):
    from logpond.operators import bodyindex as BI
    from logpond.operators import search as Q
    src, out = tmp_dir + "/src", tmp_dir + "/out"
    _envelopes(spark, src)
    _run(spark, src, out)
    before = I.read_stream_logs(spark, out)
    body = before.select("trace_id", "body").orderBy("trace_id").collect()
    days = [str(r[0]) for r in before.select("log_date").distinct().collect()]
    I.compact_logs(spark, out, days, num_files=8)
    index = C.read(spark, out, "bodies", BI.SCHEMA)
    assert index.select("file").distinct().count() == 8
    whole = body[7]["body"]
    terms = [whole, whole.upper(), whole[3:20], whole[:2], "", "%", "click%user", "user 4_ ", "no such text", "ÄÖ", "a\\_b",
             "error by user 7", '"k"']
    skipped = 0
    for term in terms:
        for literal in (False, True):
            f = Q.LogFilter(body=term, literal=literal)
            got = Q.apply_filter(I.read_stream_logs(spark, out, body=term, literal=literal), f).select("trace_id").collect()
            want = Q.apply_filter(I.read_stream_logs(spark, out), f).select("trace_id").collect()
            assert sorted(got) == sorted(want), term
            skipped += len(BI.cannot_match(index, term, literal))
    assert BI.cannot_match(index, whole) and len(BI.cannot_match(index, "no such text")) == 8 and skipped >= 16
    plan = I.read_stream_logs(spark, out, body="no such text")
    assert plan.rdd.getNumPartitions() >= 0 and plan.count() == 0
    # rows that came later have no index and are read
    I.process_batch(read_envelopes(spark, src).filter("batch_id = 0"), 50, I.IngestPaths(out))
    f = Q.LogFilter(body=whole)
    assert Q.apply_filter(I.read_stream_logs(spark, out, body=whole), f).count() == Q.apply_filter(
        I.read_stream_logs(spark, out), f).count() >= 1


def test_compacted_files_are_narrow_in_service_and_in_time(spark, tmp_dir):
    out = tmp_dir + "/out"
    day = read_logs(spark, SF_SMALL).withColumn("log_date", F.lit("2024-01-01").cast("date")).withColumn(
        "ts", F.timestamp_micros(F.lit(1704067200000000) + F.col("event_id") * 86_400_000)).withColumn(
        "service_name", F.concat(F.lit("svc-"), F.pmod(F.xxhash64("event_id"), F.lit(8)))).drop("event_id")
    attempt = C.new_attempt(0)
    C.append(day, out, I.LOGS, attempt, "log_date")
    I.write_rollups(day, attempt, I.IngestPaths(out))
    C.commit(spark, out, 0, attempt, day.count())
    I.compact_logs(spark, out, ["2024-01-01"], num_files=16)
    assert I.read_stream_logs(spark, out).count() == day.count()
    last = [d for d in os.listdir(f"{out}/{I.LOGS}/log_date=2024-01-01") if attempt not in d][0]
    files = spark.read.parquet(f"{out}/{I.LOGS}/log_date=2024-01-01/{last}").groupBy("_metadata.file_name").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min("service_name").alias("s0"), F.max("service_name").alias("s1")).collect()
    assert len(files) == 16
    for service in ("svc-0", "svc-3", "svc-7"):
        assert sum(f["s0"] <= service <= f["s1"] for f in files) <= 8
    for hour in (3, 12, 21):
        at = f"2024-01-01 {hour:02d}:30:00"
        assert sum(str(f["t0"]) <= at <= str(f["t1"]) for f in files) <= 8


def test_partition_bytes_are_those_of_the_visible_files(spark, tmp_dir):
    src, out = tmp_dir + "/src", tmp_dir + "/out"
    _envelopes(spark, src)
    _run(spark, src, out)

    def listed(attempts):
        total = {}
        for top, _, names in os.walk(I.IngestPaths(out).logs):
            if any(f"attempt={a}" in top for a in attempts):
                key = top.split("log_date=")[1].split("/")[0]
                total[key] = total.get(key, 0) + sum(os.path.getsize(f"{top}/{n}") for n in names if n.endswith(".parquet"))
        return total

    def found():
        return {str(r["log_date"]): r["partition_bytes"] for r in I.stream_partition_bytes(spark, out).collect()}

    batches = [r["attempt"] for r in C.finished(spark, out).collect()]
    assert found() == listed(batches) and found()
    I.compact_logs(spark, out, list(found()))          # the old files are still there, and no longer counted
    merged = [r["attempt"] for r in C.finished(spark, out).where("merged is not null").collect()]
    assert found() == listed(merged)


def test_a_batch_adds_one_rollup_file_to_an_hour(spark, tmp_dir):
    """however many tasks hold rows of the hour."""
    rows = read_logs(spark, SF_SMALL).repartition(4)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")        # else so small a batch is one task anyway
    try:
        I.write_rollups(rows, C.new_attempt(0), I.IngestPaths(tmp_dir))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    files = {top: [n for n in names if n.endswith(".parquet")] for top, _, names in os.walk(tmp_dir) if "attempt=" in top}
    assert files and {len(n) for n in files.values()} == {1}


def test_source_files_hold_ranges_of_arrival_and_the_last_are_found_by_all_tasks(spark, tmp_dir):
    """A micro-batch touches few hours; no task reads the table."""
    from logpond.plans.q_stream import LAST_ENVELOPES, _by_arrival
    env = spark.range(400).select(F.col("id").alias("batch_id"), F.lit(b"x").alias("payload")).repartition(5, "batch_id")
    env.write.parquet(tmp_dir + "/staged")
    early, late = _by_arrival(spark.read.parquet(tmp_dir + "/staged"))
    assert "Coalesce" not in late._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in late._jdf.queryExecution().executedPlan().toString()
    late.write.parquet(tmp_dir + "/late")
    assert len([n for n in os.listdir(tmp_dir + "/late") if n.endswith(".parquet")]) == 1
    assert sorted(r[0] for r in spark.read.parquet(tmp_dir + "/late").select("batch_id").collect()) == list(
        range(400 - LAST_ENVELOPES, 400))
    n = early.count()
    parts = early.groupBy(F.spark_partition_id().alias("p")).agg(
        F.min("batch_id").alias("a"), F.max("batch_id").alias("b")).orderBy("a").collect()
    assert n == 400 - LAST_ENVELOPES and all(x["b"] < y["a"] for x, y in zip(parts, parts[1:]))


def test_body_index_of_repeated_bodies(spark):
    """The index has every trigram of a file, whatever its number of copies."""
    from logpond.operators import bodyindex as BI
    rows = spark.createDataFrame([("f", "abcabcabc"), ("f", "abcabcabc"), ("g", "xyz"), ("g", None), ("g", "")], "file string, body string")
    one = spark.createDataFrame([("f", "abcab"), ("g", "xyz")], "file string, body string")
    key = lambda df: sorted((r["file"], r["k"], bytes(r["bits"])) for r in BI.build(df).collect())
    assert key(rows) == key(one)
    plan = BI.build(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 2                  # positions are made distinct before they are sorted
