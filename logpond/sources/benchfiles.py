"""Load-test result reader (S13): run summaries and queue-depth samples.

Layout: one folder per run, ``<config path>/<rate>rps/metrics.json`` (a
pretty-printed or single-line JSON object of latency figures in
nanoseconds) and ``queue_depth.csv`` (``timestamp,pending_messages``). The
run is taken from the folder names, so a whole tree of runs is read by one
scan per file kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logpond.operators import queue as QU

SUMMARY_DDL = ("latencies struct<total: bigint, mean: bigint, `50th`: bigint, `90th`: bigint, `95th`: bigint, "
               "`99th`: bigint, max: bigint, min: bigint>, bytes_in struct<total: bigint, mean: double>, "
               "bytes_out struct<total: bigint, mean: double>, earliest string, latest string, end string, "
               "duration bigint, wait bigint, requests bigint, rate double, throughput double, success double, "
               "status_codes map<string, bigint>, errors array<string>")


def _run_cols(root: str):
    """run, config_path and rps from ``<root>/<config...>/<n>rps/<file>``;
    the configuration is named below ``root``."""
    top = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    below = F.substring_index("_path", top, -1)
    run = F.regexp_extract(below, r"^(.*)/[^/]+$", 1)
    return (run.alias("run"), F.regexp_extract(run, r"^(.*)/[0-9]+rps$", 1).alias("config_path"),
            F.regexp_extract(run, r"([0-9]+)rps$", 1).cast("int").alias("rps"))


def read_run_summaries(spark: SparkSession, root: str) -> DataFrame:
    df = (spark.read.schema(SUMMARY_DDL).option("multiLine", "true")
          .option("recursiveFileLookup", "true").option("pathGlobFilter", "metrics.json").json(root)
          .withColumn("_path", F.input_file_name()))
    run, config, rps = _run_cols(root)
    return df.select(run, config, rps,
                     (F.col("latencies.`99th`") / 1e6).alias("p99_ms"),
                     (F.col("latencies.mean") / 1e6).alias("mean_ms"),
                     (F.col("duration") / 1e9).alias("load_seconds"),
                     "requests", "throughput", "success")


def read_queue_depth(spark: SparkSession, root: str) -> DataFrame:
    df = (spark.read.schema("timestamp timestamp, pending_messages bigint").option("header", "true")
          .option("recursiveFileLookup", "true").option("pathGlobFilter", "queue_depth.csv").csv(root)
          .withColumn("_path", F.input_file_name()))
    run, config, rps = _run_cols(root)
    return df.select(run, config, rps, F.col("timestamp").alias("ts"), F.col("pending_messages").alias("num_pending"))


#: backlog growth, as a share of the offered rate, that still counts as stable
GROWTH_SHARE = 0.01


def run_verdicts(spark: SparkSession, root: str, growth_share: float = GROWTH_SHARE,
                 p99_limit_ms: float = 100.0) -> DataFrame:
    """A13 on load-test output: per run the peak backlog, the slope of the
    backlog while the load was on and the stable flag; per configuration the
    ceiling (highest rate before the first unstable or slow one)."""
    summaries = read_run_summaries(spark, root)
    depth = read_queue_depth(spark, root).join(
        summaries.select("run", "load_seconds", (F.col("rps") * growth_share).alias("allowed")), "run")
    stab = QU.queue_stability(depth, run_col="run", load_col="load_seconds", allowed_col="allowed")
    runs = summaries.join(stab, "run", "left")
    runs = runs.withColumn("stable", F.coalesce(F.col("stable"), F.lit(False)))
    ceiling = QU.throughput_ceiling(runs.withColumn("config", F.col("config_path")), p99_limit_ms)
    return runs.join(ceiling.withColumnRenamed("config", "config_path"), "config_path", "left")
