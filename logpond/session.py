"""Spark session defaults and the shared checkpoint folder.

Every operator in the package takes and returns DataFrames; this module only
holds the session settings the operators rely on (UTC clock, AQE) and the
helper that finds the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session of the package needs. Partition counts are left to
# the caller: on a cluster they come from the job config; tests pass a small
# number.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# For a session that handles payloads: its Python steps work per envelope (tens
# of KB each, megabytes from some senders, and many times that decompressed), so
# small batches, by rows and by bytes, bound the memory of the reader and of the
# Python workers whatever the table's size, and let Python decode one batch
# while the JVM parses the one before.
INGEST_SETTINGS = {
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20),
}


def get_spark(master: str | None = None, app_name: str = "logpond",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return (or create) a session with the package defaults applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    apply_runtime_defaults(spark)
    return spark


def apply_runtime_defaults(spark: SparkSession) -> None:
    """Pin the settings operators depend on for an already running session
    and make the package importable on the executors."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    ship_package(spark)


def payload_session(spark: SparkSession) -> SparkSession:
    """A session like this one with ``INGEST_SETTINGS``, for jobs that hand
    payloads to Python. The given session keeps its own batches."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.get(key, None) != value:         # set while the session ran
            own.conf.set(key, value)
    for key, value in INGEST_SETTINGS.items():
        own.conf.set(key, value)
    return own


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Zip this package once per application and ``addPyFile`` it, so Python
    workers (pandas UDFs) can import it wherever the driver was started."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a context (remote clients)
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="logpond-pkg-")
    zpath = os.path.join(out_dir, "logpond.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` (a path every executor and
    the driver can reach). Only a local session without one, as in tests,
    gets a fresh local folder; on a cluster its absence is an error, since
    executors would write to disks that nobody else can read.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    ctx_dir = spark.sparkContext.getCheckpointDir()
    if ctx_dir:
        return ctx_dir
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    conf_dir = tempfile.mkdtemp(prefix="logpond-ckpt-")
    spark.conf.set("spark.checkpoint.dir", conf_dir)
    spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
