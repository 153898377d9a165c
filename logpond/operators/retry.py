"""Retry / dead-letter routing of failed deliveries (ST7, S9, A12).

A failed batch insert is a table of failures (one row per message with its
delivery count). Routing is a pure column expression, so it runs where the
failures are; the ingest stream stores what it routes and unions due retries
into its next batch (``streaming.ingest.process_batch``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logpond import schema as S

DLQ_SCHEMA = T.StructType([
    T.StructField("msg_id", T.LongType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("content_encoding", T.StringType()),
    T.StructField("num_delivered", T.IntegerType()),
    T.StructField("failure_reason", T.StringType()),
    T.StructField("dead_at", T.TimestampType()),
])


def backoff_delay(num_delivered, backoff_seconds: list[int]) -> Column:
    """Delay for the n-th delivery: ``backoff[n-1]``; n = 0 takes the first
    value, n past the end the last; an empty list gives 0."""
    n = F.col(num_delivered) if isinstance(num_delivered, str) else num_delivered
    if not backoff_seconds:
        return F.lit(0)
    arr = F.array(*[F.lit(int(s)) for s in backoff_seconds])
    size = len(backoff_seconds)
    return F.when(n >= size, F.lit(int(backoff_seconds[-1]))).otherwise(
        F.element_at(arr, F.greatest(n.cast("int"), F.lit(1))))


def retry_route(failures: DataFrame, max_deliver: int = S.MAX_DELIVER,
                backoff_seconds: list[int] = (5, 30, 60, 300, 3600),
                failed_at: str = "failed_at") -> DataFrame:
    """ST7: ``action`` = ``dlq`` when delivered >= max, else ``retry`` with
    ``delay_seconds`` and ``next_attempt_at``; missing delivery metadata
    (NULL count) retries after 30 s."""
    n = F.col("num_delivered")
    action = F.when(n.isNotNull() & (n >= max_deliver), F.lit("dlq")).otherwise(F.lit("retry"))
    delay = (F.when(n.isNull(), F.lit(S.MISSING_METADATA_DELAY_SECONDS))
             .when(n >= max_deliver, F.lit(None).cast("int"))
             .otherwise(backoff_delay(n, list(backoff_seconds))))
    out = failures.withColumn("action", action).withColumn("delay_seconds", delay.cast("int"))
    if failed_at in failures.columns:
        out = out.withColumn("next_attempt_at", F.when(
            F.col("delay_seconds").isNotNull(),
            F.col(failed_at) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("delay_seconds"))))
    return out


def due_retries(routed: DataFrame, as_of=None) -> DataFrame:
    """ST7: retries whose backoff has passed at ``as_of``, with the delivery
    count advanced, ready to be unioned into the next batch's envelopes."""
    from logpond.operators.dashboards import as_of_col
    due = routed.filter((F.col("action") == "retry") & (F.col("next_attempt_at") <= as_of_col(as_of)))
    return (due.withColumn("num_delivered", (F.coalesce(F.col("num_delivered"), F.lit(0)) + 1).cast("int"))
            .drop("action", "delay_seconds", "next_attempt_at"))


def dead_letters(routed: DataFrame, reason: str = "max deliveries reached") -> DataFrame:
    """Rows routed to the dead-letter queue, in the DLQ table shape."""
    d = routed.filter(F.col("action") == "dlq")
    cols = []
    for f in DLQ_SCHEMA.fields:
        if f.name == "failure_reason":
            cols.append(F.coalesce(F.col("failure_reason"), F.lit(reason)).alias(f.name)
                        if "failure_reason" in d.columns else F.lit(reason).alias(f.name))
        elif f.name == "dead_at":
            cols.append((F.col("failed_at") if "failed_at" in d.columns else F.current_timestamp()).cast("timestamp").alias(f.name))
        elif f.name in d.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return d.select(*cols)


def dlq_sink(routed: DataFrame, path: str) -> None:
    """Append dead letters (payload and original headers kept)."""
    (dead_letters(routed).withColumn("dead_date", F.to_date("dead_at"))
     .write.mode("append").partitionBy("dead_date").parquet(path))


def read_dlq(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dlq_depth(dlq: DataFrame) -> DataFrame:
    """Number of messages in the dead-letter table."""
    return dlq.agg(F.count(F.lit(1)).alias("num_messages"))
