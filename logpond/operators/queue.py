"""Queue backlog samples and analysis.

Samples are one row per (time, consumer). The stability verdict per run
uses only aggregations (partial, so a long run is never gathered into one
task) and a join of per-run midpoints back to the samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logpond import schema as S
from logpond.operators.dashboards import as_of_col, seconds


def append_samples(samples: DataFrame, path: str) -> None:
    """Append queue samples, partitioned by day (TTL pruning unit)."""
    (samples.withColumn("sample_date", F.to_date("ts"))
     .write.mode("append").partitionBy("sample_date").parquet(path))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.QUEUE_SAMPLE_SCHEMA).parquet(path)


def queue_depth_series(samples: DataFrame, as_of=None, minutes: int = S.QUEUE_DEPTH_MINUTES) -> DataFrame:
    """T4: samples of the last ``minutes`` (all consumers mixed), with the
    epoch-ms time the chart uses; sort with ``orderBy('ts_ms')`` to read."""
    now = as_of_col(as_of)
    recent = samples.filter((F.col("ts") >= now - seconds(60 * minutes)) & (F.col("ts") <= now))
    return recent.select(F.unix_millis("ts").alias("ts_ms"), "consumer_name",
                         "num_pending", "num_ack_pending", "num_redelivered")


def queue_depth_arrays(samples: DataFrame, as_of=None, minutes: int = S.QUEUE_DEPTH_MINUTES) -> DataFrame:
    """T4 chart shape: parallel arrays ordered by time. The window holds at
    most ``minutes`` x samples-per-minute x consumers entries."""
    s = queue_depth_series(samples, as_of, minutes)
    a = s.agg(F.array_sort(F.collect_list(F.struct("ts_ms", "consumer_name", "num_pending",
                                                   "num_ack_pending", "num_redelivered"))).alias("a"))
    return a.select(F.transform("a", lambda x: x["ts_ms"]).alias("timestamps"),
                    F.transform("a", lambda x: x["num_pending"]).alias("num_pending"),
                    F.transform("a", lambda x: x["num_ack_pending"]).alias("num_ack_pending"),
                    F.transform("a", lambda x: x["num_redelivered"]).alias("num_redelivered"))


def queue_stability(samples: DataFrame, run_col: str = "consumer_name", max_slope: float = 0.0,
                    max_end_pending: int | None = None, load_col: str | None = None,
                    allowed_col: str | None = None) -> DataFrame:
    """Per run, the peak backlog, the last backlog and the slope of the
    backlog (messages / s) over the second half of the time under load. Load
    starts with the first sample and lasts ``load_col`` seconds (a column of
    the run); without it, until the last sample. Samples after it show the
    backlog drain, which says nothing about growth. A run is stable when the
    slope is at most ``allowed_col`` (a column of the run) or ``max_slope``
    (and, when given, the last value is at most ``max_end_pending``)."""
    t = F.unix_micros("ts") / 1e6
    load = F.max(F.col(load_col)) if load_col else F.max(t) - F.min(t)
    allowed = F.max(F.col(allowed_col)) if allowed_col else F.lit(float(max_slope))
    # pass 1: everything per run that needs no midpoint (partial aggregates)
    stats = samples.groupBy(run_col).agg(
        F.min(t).alias("_from"), load.alias("_load"), allowed.alias("_allowed"),
        F.max("num_pending").alias("peak_pending"),
        F.max_by("num_pending", "ts").alias("last_pending"),
        F.count(F.lit(1)).alias("samples"))
    # pass 2: slope over the second half under load (one row per run joined back)
    under_load = samples.join(stats.select(run_col, "_from", "_load"), run_col).filter(
        (t >= F.col("_from") + F.col("_load") / 2) & (t <= F.col("_from") + F.col("_load")))
    slope = under_load.groupBy(run_col).agg(F.regr_slope(F.col("num_pending").cast("double"), t).alias("slope"))
    out = stats.join(slope, run_col, "left")
    stable = F.coalesce(F.col("slope"), F.lit(0.0)) <= F.col("_allowed")
    if max_end_pending is not None:
        stable = stable & (F.col("last_pending") <= max_end_pending)
    return out.withColumn("stable", stable).drop("_from", "_load", "_allowed")


def throughput_ceiling(runs: DataFrame, p99_limit_ms: float = 100.0) -> DataFrame:
    """A13 ceiling: the highest request rate below the first one that is
    unstable or reaches the p99 limit, per configuration (``runs``: config,
    rps, p99_ms, stable)."""
    ok = F.coalesce(F.col("stable") & (F.col("p99_ms") < p99_limit_ms), F.lit(False))
    first = runs.groupBy("config").agg(F.min(F.when(~ok, F.col("rps"))).alias("_first"))
    good = runs.filter(ok).join(first, "config").filter(F.col("_first").isNull() | (F.col("rps") < F.col("_first")))
    return good.groupBy("config").agg(F.max("rps").alias("ceiling_rps"),
                                      F.max_by("p99_ms", "rps").alias("p99_at_ceiling_ms"))
