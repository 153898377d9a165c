"""One visible commit per batch (ST3).

Every output of an attempt to write a batch lies in folders ``attempt=<name>``,
whatever table it belongs to. Nobody sees any of it until one row in the
``commits`` table names the attempt, and that row is one file: the logs,
rollups, quarantine, retries and dead letters of a batch appear together or
not at all. An attempt that failed half-way is simply never named; a batch
that is replayed after its commit is recognised and left alone.

A maintenance job is an attempt too. Its commit row says which part of which
table it rewrote (``merged``, ``part``) and up to which batch (``upto``):
readers then take the part from that attempt and later batches only. Nothing
is renamed and nothing that a reader may hold is touched; ``vacuum`` later
deletes what no commit shows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logpond.operators.storage import table_exists

COMMIT_SCHEMA = T.StructType([
    T.StructField("attempt", T.StringType()), T.StructField("batch_id", T.LongType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("merged", T.StringType()), T.StructField("part", T.StringType()),
    T.StructField("upto", T.LongType()), T.StructField("version", T.LongType())])

_DIGITS = 15


def new_attempt(batch_id: int) -> str:
    return f"{batch_id:0{_DIGITS}d}-{uuid.uuid4().hex[:12]}"


def batch_of(attempt: str = "attempt"):
    """The batch of an attempt, from its name: a filter on it prunes folders."""
    return F.substring(attempt, 1, _DIGITS).cast("bigint")


def finished(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/commits"
    if not table_exists(spark, path):
        return spark.createDataFrame([], COMMIT_SCHEMA)
    return spark.read.schema(COMMIT_SCHEMA).parquet(path).select(*COMMIT_SCHEMA.names).distinct()


def is_finished(spark: SparkSession, root: str, batch_id: int) -> bool:
    return not finished(spark, root).where((F.col("batch_id") == batch_id) & F.col("merged").isNull()).isEmpty()


def last_finished(spark: SparkSession, root: str) -> int | None:
    return finished(spark, root).where("merged is null").agg(F.max("batch_id").alias("b")).first()["b"]


def _write(spark: SparkSession, root: str, rows: list[dict], entry: str) -> None:
    table = spark.createDataFrame([tuple(r.get(c) for c in COMMIT_SCHEMA.names) for r in rows], COMMIT_SCHEMA)
    table.coalesce(1).write.mode("append").parquet(f"{root}/commits/entry={entry}")


def commit(spark: SparkSession, root: str, batch_id: int, attempt: str, n_rows: int = 0) -> None:
    """The attempt becomes visible as the batch's outcome."""
    _write(spark, root, [{"attempt": attempt, "batch_id": batch_id, "n_rows": n_rows}], attempt)


def commit_parts(spark: SparkSession, root: str, table: str, parts: list[str], upto: int, attempt: str) -> None:
    """The attempt takes the place of all batches up to ``upto`` in these
    parts of the table. One maintenance job runs at a time."""
    seen = finished(spark, root).where(F.col("merged") == table).agg(F.max("version").alias("v")).first()["v"] or 0
    _write(spark, root, [{"attempt": attempt, "merged": table, "part": p, "upto": upto, "version": seen + 1}
                         for p in parts], attempt)


def visible(spark: SparkSession, root: str, table: str, rows: DataFrame, part: str | None = None) -> DataFrame:
    """The rows that commits show. ``rows`` has the column ``attempt``."""
    done = finished(spark, root)
    shown = rows.join(done.select("attempt").distinct(), "attempt", "left_semi")
    if part is None:
        return shown
    latest = done.where(F.col("merged") == table).groupBy(F.col("part").alias("_part")).agg(
        F.max_by(F.struct("attempt", "upto"), "version").alias("_m"))
    return shown.join(latest, F.col(part).cast("string") == F.col("_part"), "left").where(
        F.col("_m").isNull() | (F.col("attempt") == F.col("_m.attempt")) | (batch_of() > F.col("_m.upto"))).drop("_part", "_m")


def read(spark: SparkSession, root: str, table: str, schema: T.StructType, part: str | None = None,
         without: list[str] = ()) -> DataFrame:
    """A table of the ingest (its visible rows, with ``attempt``), but for the
    files named in ``without``."""
    full = T.StructType(schema.fields + [T.StructField("attempt", T.StringType())])
    path = f"{root}/{table}"
    if not table_exists(spark, path):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(path)
    if without:
        rows = rows.where(~F.col("_metadata.file_name").isin(list(without)))
    return visible(spark, root, table, rows, part)


def append(rows: DataFrame, root: str, table: str, attempt: str, *parts: str) -> None:
    """Write rows of an attempt; they are not visible before its commit."""
    (rows.withColumn("attempt", F.lit(attempt)).write.mode("append").option("compression", "zstd")
     .partitionBy(*parts, "attempt").parquet(f"{root}/{table}"))


def merge_log(spark: SparkSession, root: str) -> None:
    """Gather the one-row files of ``commits`` in one file. Readers take
    distinct rows, so a death between the two steps changes nothing."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return
    old = [st.getPath() for st in fs.listStatus(path) if st.getPath().getName().startswith("entry=")]
    names = [p.getName()[len("entry="):] for p in old]
    rows = spark.read.schema(T.StructType(COMMIT_SCHEMA.fields + [T.StructField("entry", T.StringType())])).parquet(
        f"{root}/commits").where(F.col("entry").isin(names)).select(*COMMIT_SCHEMA.names).distinct()
    rows.coalesce(1).write.mode("append").parquet(f"{root}/commits/entry=all-{uuid.uuid4().hex[:12]}")
    for p in old:
        fs.delete(p, True)


def vacuum(spark: SparkSession, root: str, tables: dict[str, str | None]) -> int:
    """Delete the folders that no commit shows: attempts that failed, and
    parts that a maintenance job has replaced. ``tables``: path and the column
    of their parts. Folders of batches after the last finished one may belong
    to a running attempt and stay. Returns the number of folders deleted."""
    last = last_finished(spark, root)
    if last is None:
        return 0
    jvm, gone = spark.sparkContext._jvm, 0
    for table, part in tables.items():
        if not table_exists(spark, f"{root}/{table}"):
            continue
        depth = f"{part}=*/attempt=*" if part else "attempt=*"
        base = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
        fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = {}
        for st in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/{depth}")) or []:
            p = st.getPath()
            value = p.getParent().getName().partition("=")[2] if part else None
            found[value, p.getName().partition("=")[2]] = p
        if not found:
            continue
        listed = spark.createDataFrame(list(found), "p string, attempt string").where(batch_of() <= last)
        shown = visible(spark, root, table, listed, "p" if part else None)
        for r in listed.join(shown, ["p", "attempt"], "left_anti").collect() if part else listed.join(
                shown, "attempt", "left_anti").collect():           # folder names
            fs.delete(found[r["p"], r["attempt"]], True)
            gone += 1
    return gone
