"""Logs table storage: sink, scan, id check, load-if-empty, partition sizes,
storage outlook, disk cards and retention (S4-S6, S11, A14-A17, ST8, ST9).

Layout of the logs table: Parquet (zstd) partitioned by ``log_date``, rows
hash-partitioned on (log_date, service_name, minute) before the write and
sorted by (log_date, service_name, ts) inside each file, so a hot day or
service is split over several files and row-group min/max statistics on
service / time are tight. A hash needs no sample of the input, so a decode in
front of the write runs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logpond import schema as S
from logpond.operators.dashboards import as_of_col
from logpond.operators.prefix import running_sum_desc

SORT_KEY = ("service_name", "ts", "severity_number")


# ---------------------------------------------------------------------------
# Sink and scan
# ---------------------------------------------------------------------------
def prepare_for_write(logs: DataFrame, num_files: int | None = None) -> DataFrame:
    out = logs.withColumn("inserted_at", F.coalesce(F.col("inserted_at"),
                                                    F.date_trunc("second", F.current_timestamp())))
    if "log_date" not in out.columns:
        out = out.withColumn("log_date", F.to_date("ts"))
    keys = ["log_date", *SORT_KEY]
    by = ["log_date", "service_name", F.date_trunc("minute", "ts")]
    dealt = out.repartition(num_files, *by) if num_files else out.repartition(*by)
    return dealt.sortWithinPartitions(*keys)


def write_logs(logs: DataFrame, path: str, mode: str = "append", num_files: int | None = None) -> None:
    """Append rows to the logs table."""
    (prepare_for_write(logs, num_files).write.mode(mode)
     .option("compression", "zstd").partitionBy("log_date").parquet(path))


def read_logs_table(spark: SparkSession, path: str) -> DataFrame:
    """The logs table; filters on ``ts`` should come with a ``log_date``
    range (``operators.search`` adds one) so whole days are pruned."""
    return spark.read.schema(S.LOGS_SCHEMA).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def load_if_empty(spark: SparkSession, path: str, rows: DataFrame) -> bool:
    """Write ``rows`` only when the table has no rows; True if written."""
    if table_exists(spark, path) and not read_logs_table(spark, path).isEmpty():
        return False
    write_logs(rows, path, mode="append")
    return True


# ---------------------------------------------------------------------------
# Id check
# ---------------------------------------------------------------------------
def id_violation() -> Column:
    return ((F.length("trace_id") != S.TRACE_ID_HEX_LEN) | (F.length("span_id") != S.SPAN_ID_HEX_LEN)
            | F.col("trace_id").isNull() | F.col("span_id").isNull())


def id_check_counts(logs: DataFrame) -> DataFrame:
    """One row: valid / invalid counts (partial aggregation, one pass)."""
    return logs.agg(F.count_if(~id_violation()).alias("valid"), F.count_if(id_violation()).alias("invalid"))


def validate_ids(logs: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """S5. Strict mode: the whole batch fails when any id has the wrong
    length (raises ``ValueError``); an empty batch is a no-op. Quarantine
    mode: returns (valid rows, invalid rows)."""
    if strict:
        bad = logs.filter(id_violation()).limit(1).count()
        if bad:
            raise ValueError("batch rejected: TraceId must be 32 and SpanId 16 hex characters")
        return logs, logs.limit(0)
    return logs.filter(~id_violation()), logs.filter(id_violation())


# ---------------------------------------------------------------------------
# Sizes, outlook, disks, runway
# ---------------------------------------------------------------------------
def logical_row_bytes() -> Column:
    str_cols = ["trace_id", "span_id", "severity_text", "service_name", "body", "body_type",
                "scope_name", "scope_version"]
    total = F.lit(0)
    for c in str_cols:
        total = total + F.coalesce(F.octet_length(c), F.lit(0))
    for c in ["log_attr_keys", "log_attr_values", "res_attr_keys", "res_attr_values"]:
        total = total + F.coalesce(F.aggregate(F.col(c), F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
    return total + 8 * 3 + 1   # three timestamps and the severity number


def partition_bytes(logs: DataFrame, size: Column | None = None) -> DataFrame:
    """A14 (logical): bytes per day partition; ``size`` defaults to the
    uncompressed size of the row's values."""
    size = logical_row_bytes() if size is None else size
    return logs.groupBy("log_date").agg(F.sum(size).cast("bigint").alias("partition_bytes"))


def partition_bytes_on_disk(spark: SparkSession, path: str) -> DataFrame:
    """A14 (physical): file bytes per ``log_date=`` folder; the file listing
    is read without file contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return (files.select("log_date", "length")
            .groupBy("log_date").agg(F.sum("length").cast("bigint").alias("partition_bytes")))


def storage_outlook(parts: DataFrame, ttl_days: int = S.LOGS_TTL_DAYS) -> DataFrame:
    """Current total, days of history, steady-state flag and projected
    steady-state bytes. With fewer than ``ttl_days`` partitions the projection
    is the average of all partitions but the newest (all when only one)
    times ``ttl_days``, in integer arithmetic; no partitions -> 0."""
    days, total = F.col("_days"), F.col("_total")
    older = F.when(days > 1, total - F.col("_newest")).otherwise(total)
    per_day = F.floor(older.cast("decimal(38,0)") / F.greatest(days - 1, F.lit(1))).cast("bigint")
    full = days >= ttl_days
    return parts.agg(
        F.count("*").alias("_days"), F.coalesce(F.sum("partition_bytes"), F.lit(0)).cast("bigint").alias("_total"),
        F.max_by("partition_bytes", "log_date").alias("_newest"),
    ).select(total.alias("current_total_bytes"), days.cast("int").alias("days_of_history"),
             full.alias("is_steady_state"),
             F.when(full, total).otherwise(per_day * ttl_days).cast("bigint").alias("projected_steady_state_bytes"))


def disk_usage(disks: DataFrame) -> DataFrame:
    """Free, total and used percent per disk (``disks``: disk_name,
    free_bytes, total_bytes)."""
    return disks.select(
        "disk_name", "free_bytes", "total_bytes",
        F.bround((F.col("total_bytes") - F.col("free_bytes")) / F.col("total_bytes") * 100, 2).alias("used_percent"))


def storage_runway(disks: DataFrame, outlook: DataFrame, ttl_days: int = S.LOGS_TTL_DAYS) -> DataFrame:
    """The storage card from the first disk and the outlook row. The two
    one-row inputs are combined by a union + aggregate, not a join."""
    d = disks.select(F.struct("disk_name", "free_bytes", "total_bytes").alias("d"),
                     F.lit(None).cast("bigint").alias("projected"))
    o = outlook.select(F.lit(None).cast(d.schema["d"].dataType).alias("d"),
                       F.col("projected_steady_state_bytes").alias("projected"))
    one = d.unionByName(o).agg(F.min_by("d", "d.disk_name").alias("d"), F.max("projected").alias("projected"))
    return _runway_card(one.select("d.*", "projected"), ttl_days).drop("disk_name")


def storage_runways(disks: DataFrame, outlook: DataFrame, ttl_days: int = S.LOGS_TTL_DAYS) -> DataFrame:
    """A17 for every disk: the outlook is one row, broadcast."""
    one = outlook.agg(F.max("projected_steady_state_bytes").alias("projected"))
    return _runway_card(disks.join(F.broadcast(one), F.lit(True)), ttl_days)


def _runway_card(d: DataFrame, ttl_days: int) -> DataFrame:
    free, total = F.col("free_bytes"), F.col("total_bytes")
    used = total - free
    growth = (F.col("projected") - used) / F.lit(float(ttl_days))
    days = free / growth
    stable = F.col("projected") <= used
    # the card's numbers are printed with round-half-to-even (%.0f in the
    # original service); format_string alone would round half up
    days_txt = F.format_string("%.0f", F.bround(days, 0))
    soon = days <= S.RUNWAY_WARNING_DAYS
    delta = F.when(stable, F.lit(S.RUNWAY_STABLE)).otherwise(F.concat(
        F.lit("~"), days_txt, F.when(soon, F.lit(S.RUNWAY_ACTION)).otherwise(F.lit(S.RUNWAY_DAYS))))
    level = F.when(stable, F.lit("stable")).when(soon, F.lit("action")).otherwise(F.lit("growing"))
    return d.select("disk_name", F.format_string("%.0f", F.bround(used / total * 100, 0)).alias("value"),
                    F.lit("%").alias("unit"), delta.alias("delta"), level.alias("level"),
                    F.when(~stable, days).alias("days_remaining"))


# ---------------------------------------------------------------------------
# ST8 / ST9: retention
# ---------------------------------------------------------------------------
def _ttl(ttl: str) -> Column:
    return F.expr(f"INTERVAL {ttl}")


def retention_view(df: DataFrame, as_of=None, ttl: str = f"{S.LOGS_TTL_DAYS} days",
                   ts_col: str = "ts") -> DataFrame:
    """ST8 read view: rows younger than the TTL at ``as_of``. With a
    ``log_date`` column whole expired days are pruned as well."""
    cutoff = as_of_col(as_of) - _ttl(ttl)
    out = df.filter(F.col(ts_col) > cutoff)
    if "log_date" in df.columns:
        out = out.filter(F.col("log_date") >= F.to_date(cutoff))
    return out


def apply_retention(spark: SparkSession, path: str, as_of=None,
                    ttl: str = f"{S.LOGS_TTL_DAYS} days", date_col: str = "log_date") -> dict:
    """ST8 maintenance job on a table partitioned by a date column (logs by
    ``log_date``, queue samples by ``sample_date``), whatever lies below the
    day folders: deletes the days that are expired whole. The edge day stays
    as it is; readers go through ``retention_view``, which drops its expired
    rows, until the day is expired whole."""
    edge_day = spark.range(1).select(F.to_date(as_of_col(as_of) - _ttl(ttl)).alias("d")).first()["d"]
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dropped = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(f"{date_col}="):
            day = name.split("=", 1)[1]
            if day < edge_day.isoformat():
                if not fs.delete(st.getPath(), True):
                    raise OSError(f"cannot delete {st.getPath()}")
                dropped.append(day)
    return {"dropped_days": sorted(dropped)}


def retention_bytes(msgs: DataFrame, as_of=None, max_age: str = S.RAW_QUEUE_MAX_AGE,
                    max_bytes: int = S.RAW_QUEUE_MAX_BYTES, ts_col: str = "received_at",
                    size_col: str = "size", id_col: str = "msg_id",
                    bucket: str = "minute") -> DataFrame:
    """ST9: a queue's age and byte limits. Messages older than ``max_age``
    go; then the oldest go until the rest fits in ``max_bytes``.

    One aggregate pass sums sizes per time bucket (one row per bucket of
    the age window, so the cumulative pass over buckets is small). A single
    scalar row from it - the oldest bucket kept whole, the edge bucket and
    the bytes newer than the edge - turns the rest into time-range filters
    that reach the scan: rows newer than the edge are kept as they are, and
    only the edge bucket's rows get an exact running sum, computed with the
    range-partitioned prefix sum so even a hot bucket is split across tasks.
    """
    young = msgs.filter(F.col(ts_col) > as_of_col(as_of) - _ttl(max_age))
    sizes = young.groupBy(F.date_trunc(bucket, ts_col).alias("_b")).agg(F.sum(size_col).alias("_bs"))
    cum = sizes.select("_b", "_bs", F.sum("_bs").over(_desc_window("_b")).alias("_cum"))
    over = F.col("_cum") > max_bytes
    edge = cum.agg(
        F.min(F.when(~over, F.col("_b"))).alias("full_from"),
        F.max(F.when(over, F.col("_b"))).alias("edge"),
        F.max_by(F.col("_cum") - F.col("_bs"), F.when(over, F.col("_b"))).alias("before")).first()
    if edge["edge"] is None:                       # everything fits
        return young
    ts = F.col(ts_col)
    edge_start = F.lit(edge["edge"])
    edge_end = edge_start + _ttl(f"1 {bucket}")
    parts = []
    if edge["full_from"] is not None:
        parts.append(young.filter(ts >= F.lit(edge["full_from"])))
    before = int(edge["before"] or 0)
    if before <= max_bytes:
        edge_rows = young.filter((ts >= edge_start) & (ts < edge_end))
        ranked = running_sum_desc(edge_rows, [ts_col, id_col], size_col, "_run")
        parts.append(ranked.filter(F.col("_run") + before <= max_bytes).drop("_run"))
    if not parts:
        return young.limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _desc_window(col: str):
    from pyspark.sql import Window
    # one row per time bucket: bounded by the age limit, not the data volume
    return Window.orderBy(F.col(col).desc()).rowsBetween(Window.unboundedPreceding, 0)
