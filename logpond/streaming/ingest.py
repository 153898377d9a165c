"""Ingest stream (ST1-ST7, ST10) with Structured Streaming.

``readStream`` over a folder of envelope files -> decompress -> decode ->
flatten -> ``foreachBatch`` that writes, for each micro-batch:

* its rows, partitioned by outcome: log records (by ``log_date``) and
  undecodable payloads with their reason, in one pass over the payloads,
* per-second and per-minute rollup deltas and service registry deltas,
* when writing fails: its envelopes, for a later retry or as dead letters.

All of them belong to one attempt and become visible with its commit
(``streaming.commits``), so each record is seen once in every table, whatever
fails and whenever a batch is replayed (the original service is
at-least-once). Rollup readers sum the deltas (``operators.rollups``), so
late data of any age is simply counted, as in the service.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logpond import schema as S
from logpond.operators import bodyindex as BI
from logpond.operators import retry as RT
from logpond.operators import rollups as R
from logpond.operators import storage as ST
from logpond.operators.dashboards import as_of_col
from logpond.session import INGEST_SETTINGS
from logpond.sources.envelopes import decode_envelopes
from logpond.sources.otlp_json import QUARANTINE_COLUMNS, flatten_all
from logpond.streaming import commits as C

LOGS, QUARANTINE = "rows/outcome=log", "rows/outcome=bad"
KINDS = ("metrics_1s", "metrics_1m", "service_registry")


@dataclass
class IngestPaths:
    root: str

    @property
    def logs(self) -> str:
        return f"{self.root}/{LOGS}"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/_checkpoint"


def rollup_table(kind: str) -> str:
    return f"rollups/kind={kind}"


ROLLUP_COLUMNS = ["ts", "service_name", "logs_count", "errors_count", "first_seen", "last_seen"]


def rollup_deltas(rows: DataFrame) -> DataFrame:
    """The three delta kinds of one batch as one frame (``kind`` column):
    the 1 s rollup, the 1 m rollup and the registry, the last two derived
    from the first (both are exact functions of the per-second counts)."""
    m1s = R.metrics_1s(rows)
    null_ts = F.lit(None).cast("timestamp")
    null_n = F.lit(None).cast("bigint")
    a = m1s.select(F.lit("metrics_1s").alias("kind"), "ts", "service_name", "logs_count", "errors_count",
                   null_ts.alias("first_seen"), null_ts.alias("last_seen"))
    b = R.metrics_1m(m1s).select(F.lit("metrics_1m").alias("kind"), "ts", "service_name", "logs_count",
                                 "errors_count", null_ts.alias("first_seen"), null_ts.alias("last_seen"))
    c = (m1s.groupBy("service_name").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
         .select(F.lit("service_registry").alias("kind"), null_ts.alias("ts"), "service_name",
                 null_n.alias("logs_count"), null_n.alias("errors_count"), "first_seen", "last_seen"))
    return a.unionByName(b).unionByName(c).withColumn("bucket", bucket_of("ts"))


def bucket_of(ts) -> Column:
    """The hour folder of a rollup row, ``yyyy-MM-dd-HH`` (registry rows have
    no time and lie in ``all``)."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd-HH"), F.lit("all"))


def write_rollups(rows: DataFrame, attempt: str, paths: IngestPaths) -> None:
    """The rollup and registry deltas of one batch of log rows, by kind and
    hour. An hour's deltas (at most its seconds times the services) go to one
    task, so a batch adds one file to an hour, however many tasks it has."""
    deltas = rollup_deltas(rows).repartition(rows.sparkSession.sparkContext.defaultParallelism, "kind", "bucket")
    C.append(deltas, paths.root, "rollups", attempt, "kind", "bucket")


def process_batch(env: DataFrame, batch_id: int, paths: IngestPaths, now=None, rollups=write_rollups) -> None:
    """One micro-batch and its commit. Retries that are due join it. When
    writing fails, the batch's outcome is that its envelopes are routed by
    their delivery count (``operators.retry``): to the retry table with a
    delay, or to the dead letters; the stream goes on. Only a failure to store
    the failures ends the query, uncommitted. ``now`` (a time) and ``rollups`` (the job that writes them)
    are for tests."""
    spark = env.sparkSession
    if C.is_finished(spark, paths.root, batch_id):
        return                                   # replayed after its commit
    waiting = due_retries(spark, paths, now)
    if waiting is not None:
        env = env.unionByName(waiting.drop("attempt", "due"), allowMissingColumns=True)
    attempt, n_rows = C.new_attempt(batch_id), 0
    try:
        n_rows = write_batch(env, attempt, paths, rollups)
    except Exception as e:  # noqa: BLE001 - any failed write is retried
        attempt = C.new_attempt(batch_id)        # what the failed one has written is never seen
        store_failures(env, attempt, paths, f"{type(e).__name__}: {e}", now)
    if waiting is not None:
        claims = waiting.select(F.col("attempt").alias("retry_attempt"), "due").distinct()
        C.append(claims, paths.root, "claims", attempt)
    C.commit(spark, paths.root, batch_id, attempt, n_rows)


def _clock(now):
    return F.current_timestamp() if now is None else F.lit(now).cast("timestamp")


RETRY_SCHEMA = T.StructType(S.ENVELOPE_SCHEMA.fields + [T.StructField("due", T.LongType())])
CLAIM_SCHEMA = T.StructType([T.StructField("retry_attempt", T.StringType()), T.StructField("due", T.LongType())])


def store_failures(env: DataFrame, attempt: str, paths: IngestPaths, reason: str, now=None) -> None:
    """ST7 + S9: the envelopes of a failed batch, as retries with the second
    from which they are due, and as dead letters."""
    failed = env.withColumn("msg_id", F.xxhash64("payload", "received_at")).withColumn(
        "failed_at", _clock(now)).withColumn("failure_reason", F.lit(reason))
    routed = RT.retry_route(failed)
    again = routed.filter(F.col("action") == "retry").withColumn("due", F.unix_seconds("next_attempt_at"))
    C.append(again.select(*RETRY_SCHEMA.names), paths.root, "retries", attempt)
    C.append(RT.dead_letters(routed), paths.root, "dlq", attempt)


def due_retries(spark: SparkSession, paths: IngestPaths, now=None) -> DataFrame | None:
    """The retries whose time has come and that no finished batch has
    claimed, with their delivery count advanced; None before any failure."""
    if not ST.table_exists(spark, f"{paths.root}/retries"):
        return None
    seconds = spark.range(1).select(F.unix_seconds(_clock(now)).alias("s")).first()["s"]
    claimed = C.read(spark, paths.root, "claims", CLAIM_SCHEMA).select(F.col("retry_attempt").alias("attempt"), "due")
    return (C.read(spark, paths.root, "retries", RETRY_SCHEMA).filter(F.col("due") <= seconds)
            .join(claimed, ["attempt", "due"], "left_anti")
            .withColumn("num_delivered", (F.coalesce("num_delivered", F.lit(0)) + 1).cast("int")))


def write_batch(env: DataFrame, attempt: str, paths: IngestPaths, rollups=write_rollups) -> int:
    """The output of one attempt, in two jobs; returns the number of log
    records.

    1. Decode (codec UDF + ``from_json``, once per payload) and flatten,
       written by outcome: records, and bad payloads with their reason. A
       record with an id of the wrong length (S5) fails the job. An
       ``Observation`` counts the records in the same pass, so nothing is
       cached.
    2. Rollup deltas: three columns of the records just written are read
       back; the 1 s delta is computed once (its shuffle is reused by the 1 m
       and registry deltas) and all three are written by one job.
    """
    spark = env.sparkSession
    obs = Observation(f"records_{attempt}")
    # records without a time get the envelope's arrival time, so a second
    # attempt gives them the same day as the first
    clock = F.unix_micros(F.coalesce("received_at", F.current_timestamp())) * 1000
    good = F.col("error").isNull()
    rows = (flatten_all(decode_envelopes(spread_envelopes(env)), clock, ("batch_id",))
            .withColumnRenamed("batch_id", "envelope")
            .withColumn("inserted_at", F.when(good, F.date_trunc("second", F.current_timestamp())))
            .withColumn("arrival", F.monotonically_increasing_id())
            .withColumn("outcome", F.when(good, F.lit("log")).otherwise(F.lit("bad"))))
    rows = rows.filter(F.when(good & ST.id_violation(), F.raise_error("an id has the wrong length").cast("boolean"))
                       .otherwise(F.lit(True))).observe(obs, F.count_if(good).alias("n"))
    # within-task sort only: a micro-batch is appended as one file per task
    # and day, sorted for tight row-group statistics (compaction range-
    # partitions whole days later); the key starts with the partition
    # columns, so the file writer needs no sort of its own
    rows = rows.sortWithinPartitions("outcome", "log_date", "service_name", "ts")
    C.append(rows, paths.root, "rows", attempt, "outcome", "log_date")
    n = int(obs.get.get("n") or 0)
    if n:
        # the glob lists only the day folders (bounded by retention)
        written = spark.read.parquet(f"{paths.logs}/log_date=*/attempt={attempt}")
        rollups(written.select("ts", "service_name", "severity_number"), attempt, paths)
    return n


def spread_envelopes(env: DataFrame) -> DataFrame:
    """Decoding is CPU-bound per payload, whatever files it arrived in:
    hash-partition the envelopes over the cluster's cores first (a hash, so
    a retried task sees the same rows)."""
    key = F.col("batch_id") if "batch_id" in env.columns else F.xxhash64("payload")
    return env.repartition(env.sparkSession.sparkContext.defaultParallelism, key)


def envelope_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming envelope source over a folder of parquet files. On a
    cluster the same reader shape fits a Kafka source with headers."""
    reader = spark.readStream.schema(S.ENVELOPE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.parquet(source_dir)


def kafka_envelope_stream(spark: SparkSession, bootstrap_servers: str, topic: str, *,
                          max_offsets_per_trigger: int | None = None,
                          starting_offsets: str = "earliest") -> DataFrame:
    """S2 production variant: envelopes from a Kafka topic. The payload is
    the record value; ``Content-Type`` / ``Content-Encoding`` come from the
    record headers; (partition, offset) make the batch key. Needs the Kafka
    connector on the classpath (not part of this repository's test setup)."""
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", bootstrap_servers)
              .option("subscribe", topic)
              .option("includeHeaders", "true")
              .option("startingOffsets", starting_offsets))
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", int(max_offsets_per_trigger))
    raw = reader.load()

    def header(name):
        h = F.filter(F.col("headers"), lambda x: F.lower(x["key"]) == name.lower())
        return F.try_element_at(h, F.lit(1))["value"].cast("string")

    return raw.select(
        (F.col("partition").cast("bigint") * F.lit(1 << 40) + F.col("offset")).alias("batch_id"),
        F.col("value").alias("payload"),
        header("Content-Type").alias("content_type"),
        header("Content-Encoding").alias("content_encoding"),
        F.lit(1).alias("num_delivered"),
        F.col("timestamp").alias("received_at"))


def start_ingest(spark: SparkSession, source_dir: str, out_root: str, *,
                 available_now: bool = True, processing_time: str = "2 seconds",
                 max_files_per_trigger: int | None = None, query_name: str | None = None):
    """ST1 + ST2: start the ingest query. ``available_now`` processes what is
    there and stops (tests, backfills); otherwise a ``processingTime``
    trigger batches by time, ``maxFilesPerTrigger`` by size."""
    paths = IngestPaths(out_root)
    if not ST.table_exists(spark, paths.checkpoint) and C.last_finished(spark, out_root) is not None:
        # batch numbers would begin anew, and finished ones are not written again
        raise RuntimeError(f"{out_root} holds finished batches but not the stream's checkpoint")
    stream = envelope_stream(spark, source_dir, max_files_per_trigger)

    def each(df: DataFrame, batch_id: int) -> None:
        for key, value in INGEST_SETTINGS.items():      # the stream has a session of its own
            df.sparkSession.conf.set(key, value)
        process_batch(df, batch_id, paths)

    w = (stream.writeStream.foreachBatch(each)
         .option("checkpointLocation", paths.checkpoint))
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()


# -- readers of the stream outputs (deltas are always summed on read) ---------
STREAM_LOGS_SCHEMA = T.StructType(S.LOGS_SCHEMA.fields + [
    T.StructField("envelope", T.LongType()), T.StructField("arrival", T.LongType()),
    T.StructField("arrival_batch", T.LongType())])


def _stream_logs(spark: SparkSession, out_root: str, without: list[str] = ()) -> DataFrame:
    return C.read(spark, out_root, LOGS, STREAM_LOGS_SCHEMA, "log_date", without)


def _arrived(logs: DataFrame) -> DataFrame:
    # only merged rows carry the batch that they came in
    batch = F.coalesce("arrival_batch", C.batch_of())
    return logs.withColumn("batch_id", batch).withColumn(
        "arrival_seq", F.struct("batch_id", "envelope", "arrival")).drop("arrival_batch", "attempt")


def read_stream_logs(spark: SparkSession, out_root: str, body: str = "", literal: bool = False) -> DataFrame:
    """The ingested rows; ``arrival_seq`` (batch they came in, envelope, place)
    is unique and orders them by arrival. With ``body``, the term that a search
    will look for (F8), compacted files that cannot hold it are not read."""
    skip = BI.cannot_match(C.read(spark, out_root, "bodies", BI.SCHEMA), body, literal) if body else []
    return _arrived(_stream_logs(spark, out_root, skip))


def stream_partition_bytes(spark: SparkSession, out_root: str) -> DataFrame:
    """A14 (physical) of the ingest's table: file bytes per day, of the
    attempts that commits show. Files are listed, never opened."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{out_root}/{LOGS}")
             .select("log_date", "attempt", "length"))
    return C.visible(spark, out_root, LOGS, files, "log_date").groupBy("log_date").agg(
        F.sum("length").cast("bigint").alias("partition_bytes"))


def read_quarantine(spark: SparkSession, out_root: str) -> DataFrame:
    """The payloads that could not be decoded, with their batch."""
    schema = T.StructType([T.StructField(n, t) for n, t in QUARANTINE_COLUMNS])
    return C.read(spark, out_root, QUARANTINE, schema).withColumn("batch_id", C.batch_of()).drop("attempt", "log_date")


def read_dead_letters(spark: SparkSession, out_root: str) -> DataFrame:
    return C.read(spark, out_root, "dlq", RT.DLQ_SCHEMA).drop("attempt")


def newest_rows(spark: SparkSession, out_root: str, size: int = S.LIVE_BUFFER_SIZE) -> DataFrame:
    """ST10: rows that hold the newest ``size`` arrivals, for the live tail:
    the last finished batches with so many records together. Only their
    folders are read."""
    taken, n = [], 0
    last = C.finished(spark, out_root).where("merged is null and n_rows > 0").orderBy(F.col("batch_id").desc())
    for r in last.limit(size).collect():         # every one of them has a record at least
        taken.append(r["batch_id"])
        n += r["n_rows"]
        if n >= size:
            break
    logs = _stream_logs(spark, out_root)
    if not taken:
        return _arrived(logs)
    # merged rows lie in attempts of later batches
    return _arrived(logs.where(C.batch_of() >= min(taken))).where(F.col("batch_id") >= min(taken))


DELTA_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()), T.StructField("service_name", T.StringType()),
    T.StructField("logs_count", T.LongType()), T.StructField("errors_count", T.LongType()),
    T.StructField("first_seen", T.TimestampType()), T.StructField("last_seen", T.TimestampType()),
    T.StructField("bucket", T.StringType())])


def _deltas(spark: SparkSession, out_root: str, kind: str) -> DataFrame:
    return C.read(spark, out_root, rollup_table(kind), DELTA_SCHEMA, "bucket")


def read_metrics(spark: SparkSession, out_root: str, grain: str = "1s", start=None, end=None) -> DataFrame:
    """A summed rollup; with ``start`` and ``end`` (times) only the hours
    between them are listed and read."""
    deltas = _deltas(spark, out_root, "metrics_1s" if grain == "1s" else "metrics_1m")
    if start is not None:
        deltas = deltas.filter((F.col("bucket") >= bucket_of(as_of_col(start))) & (F.col("ts") >= as_of_col(start)))
    if end is not None:
        deltas = deltas.filter((F.col("bucket") <= bucket_of(as_of_col(end))) & (F.col("ts") <= as_of_col(end)))
    return R.metrics_compact(deltas.select("ts", "service_name", "logs_count", "errors_count"))


def read_recent(spark: SparkSession, out_root: str, grain: str, as_of, seconds: int) -> DataFrame:
    """``read_metrics`` of the last ``seconds`` before ``as_of`` and of the
    second or minute that they begin in: what a panel with that look-back
    needs."""
    now = as_of_col(as_of)
    start = F.date_trunc("minute" if grain == "1m" else "second", now) - F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    return read_metrics(spark, out_root, grain, start, now)


def read_registry(spark: SparkSession, out_root: str, first_seen: str = "global") -> DataFrame:
    deltas = _deltas(spark, out_root, "service_registry")
    return R.registry_latest(deltas.select("service_name", "first_seen", "last_seen"), first_seen)


def windowed_metrics_1s(logs_stream: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """ST4 variant: event-time tumbling 1 s windows with a watermark, for an
    append-mode sink. Unlike the delta tables, rows later than the watermark
    are dropped."""
    ts = logs_stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return (ts.withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 second"), "service_name")
            .agg(F.count(F.lit(1)).alias("logs_count"), F.count_if(R.is_error()).alias("errors_count"))
            .select(F.col("window.start").alias("ts"), "service_name", "logs_count", "errors_count"))


# -- maintenance: rewritten parts, committed like batches ----------------------
def _cutoff(as_of, ttl: str) -> Column:
    return as_of_col(as_of) - F.expr(f"INTERVAL {ttl}")


#: Bits of each half of a Z-order key.
Z_BITS = 16


def z_key(services: list[str]) -> Column:
    """Place on a Z-shaped curve over service and time of day: rows that are
    close in both are close in the order, so ranges of it have narrow ranges of
    either, and a search by service alone or by time alone skips most of them.
    ``services`` are the known names in order; others share one place."""
    step = max(1, (1 << Z_BITS) // (len(services) + 1))
    places = F.create_map(*[x for k, n in enumerate(services) for x in (F.lit(n), F.lit((k + 1) * step))]) if services else None
    service = F.coalesce(F.try_element_at(places, F.col("service_name")), F.lit(0)) if services else F.lit(0)
    second = F.unix_seconds("ts") - F.unix_seconds(F.date_trunc("day", "ts"))
    time = F.floor(second * (1 << Z_BITS) / 86400)
    key = F.lit(0).cast("bigint")
    for k in range(Z_BITS):
        for place, value in ((2 * k + 1, service), (2 * k, time)):
            bit = F.shiftright(value.cast("bigint"), k).bitwiseAND(F.lit(1).cast("bigint"))
            key = key.bitwiseOR(F.shiftleft(bit, place))
    return key


def compact_logs(spark: SparkSession, out_root: str, days: list[str], as_of=None, ttl: str | None = None,
                 num_files: int | None = None) -> None:
    """Rewrite the finished batches of these days as one sorted run of files
    each, range-partitioned on day and a curve over service and time
    (``z_key``) for tight statistics by either, with an index of their bodies
    (``operators.bodyindex``). With ``ttl`` rows that are expired at ``as_of`` are left out
    (ST8: a day that is expired whole becomes empty, the edge day keeps the
    rest). Readers change over with the commit."""
    upto = C.last_finished(spark, out_root)
    if upto is None or not days:
        return
    rows = _stream_logs(spark, out_root).where(F.col("log_date").cast("string").isin(days) & (C.batch_of() <= upto))
    rows = rows.withColumn("arrival_batch", F.coalesce("arrival_batch", C.batch_of())).drop("attempt")
    if ttl is not None:
        rows = rows.where(F.col("ts") > _cutoff(as_of, ttl))
    names = [r["service_name"] for r in read_registry(spark, out_root).select("service_name").where("service_name is not null")
             .orderBy("service_name").limit(1 << (Z_BITS - 4)).collect()]
    keys = ["log_date", "_z", "service_name", "ts"]
    rows = rows.withColumn("_z", z_key(names))
    ranged = rows.repartitionByRange(num_files, *keys) if num_files else rows.repartitionByRange(*keys)
    attempt, obs = C.new_attempt(upto), Observation("compacted")
    ranged = ranged.sortWithinPartitions(*keys).drop("_z").observe(obs, F.count(F.lit(1)).alias("n"))
    C.append(ranged, out_root, LOGS, attempt, "log_date")
    if obs.get.get("n"):
        files = spark.read.parquet(f"{out_root}/{LOGS}/log_date=*/attempt={attempt}")
        C.append(BI.build(files.select(F.col("_metadata.file_name").alias("file"), "body")), out_root, "bodies", attempt)
    C.commit_parts(spark, out_root, LOGS, days, upto, attempt)


def expire_logs(spark: SparkSession, out_root: str, as_of=None, ttl: str = f"{S.LOGS_TTL_DAYS} days") -> list[str]:
    """ST8 on the stream's own table: days up to the edge day lose their
    expired rows. Returns those days."""
    edge = F.to_date(_cutoff(as_of, ttl))
    days = [str(r["log_date"]) for r in _stream_logs(spark, out_root).where(F.col("log_date") <= edge)
            .select("log_date").distinct().collect()]            # at most the days of the table
    compact_logs(spark, out_root, sorted(days), as_of, ttl)
    return sorted(days)


def compact_deltas(spark: SparkSession, out_root: str, kind: str, as_of=None, ttl: str | None = None) -> None:
    """Collapse the delta rows of the finished batches of a rollup
    (``metrics_1s``, ``metrics_1m``: summed; ``service_registry``: min / max),
    all hours in one job. Results read through the summing readers are
    unchanged. With ``ttl`` (e.g. ``"1 hour"`` for the 1 s rollup) expired rows
    are left out on the way (ST8 for the rollup tables)."""
    upto = C.last_finished(spark, out_root)
    if upto is None:
        return
    is_metric = kind != "service_registry"
    deltas = _deltas(spark, out_root, kind).where(C.batch_of() <= upto)
    hours = [r["bucket"] for r in deltas.select("bucket").distinct().collect()]      # bounded by retention
    merged = R.metrics_compact(deltas) if is_metric else R.registry_latest(deltas, "global")
    if ttl is not None:
        merged = merged.filter(F.col("ts" if is_metric else "last_seen") > _cutoff(as_of, ttl))
    merged = merged.withColumn("bucket", bucket_of("ts") if is_metric else F.lit("all"))
    attempt = C.new_attempt(upto)
    C.append(merged.repartition("bucket"), out_root, rollup_table(kind), attempt, "bucket")
    if hours:
        C.commit_parts(spark, out_root, rollup_table(kind), hours, upto, attempt)


def vacuum(spark: SparkSession, out_root: str) -> int:
    """Delete the folders that no commit shows any more, and gather the
    commits in one file. Run it when no reader holds an older view."""
    C.merge_log(spark, out_root)
    return C.vacuum(spark, out_root, {LOGS: "log_date", QUARANTINE: "log_date", "retries": None, "claims": None, "dlq": None, "bodies": None,
                                      **{rollup_table(k): "bucket" for k in KINDS}})
