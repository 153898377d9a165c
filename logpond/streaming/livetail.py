"""Live-tail stream (ST10).

A second streaming query, over the commits of the ingest: every time batches
have been finished, the newest ``size`` arrivals are read from the folders of
the last batches (``ingest.newest_rows``) and published. It keeps no table and
no state of its own, a reader that lags skips to the newest rows, and failing
to keep up never blocks the ingest: the two queries are independent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logpond import schema as S
from logpond.operators.livetail import live_buffer, live_tail_view
from logpond.streaming import commits as C
from logpond.streaming.ingest import newest_rows


def ring(spark: SparkSession, out_root: str, size: int = S.LIVE_BUFFER_SIZE) -> DataFrame:
    """The newest ``size`` arrivals of an ingest."""
    return live_buffer(newest_rows(spark, out_root, size), "arrival_seq", size)


def live_view(spark: SparkSession, out_root: str, size: int = S.LIVE_BUFFER_SIZE, **filters) -> DataFrame:
    """T6 over the ring."""
    return live_tail_view(newest_rows(spark, out_root, size), "arrival_seq", size=size, **filters)


def start_live_tail(spark: SparkSession, out_root: str, checkpoint: str, publish: Callable[[DataFrame], None],
                    size: int = S.LIVE_BUFFER_SIZE, available_now: bool = True,
                    processing_time: str = "500 milliseconds"):
    """Calls ``publish`` with the ring whenever new commits have arrived."""
    stream = spark.readStream.schema(C.COMMIT_SCHEMA).parquet(f"{out_root}/commits")
    w = (stream.writeStream.foreachBatch(lambda df, _: publish(ring(df.sparkSession, out_root, size)))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time)
    return w.start()
