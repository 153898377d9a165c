"""Derive log rows from the ``events`` table.

The input tables hold no log records, so the logs table is derived from
``events`` by fixed column expressions (no join, no shuffle): every query
that reads logs scans ``events`` and Catalyst prunes the columns it does not
need. The same mapping is written as SQL in ``plans.oracle`` for DuckDB.

Two clocks are offered:

* ``dense``: one record every 100 ms; odd minutes run at double speed and
  then stop, which leaves real gaps. Used by the per-second panels.
* ``wide``: the event's own ``ts`` (30 days). Used by partition, retention
  and storage operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logpond import schema as S
from logpond.sources.tables import read_table

# Fixed values of the mapping (shared with the SQL form in plans.oracle).
DENSE_EPOCH_MICROS = 1704067200000000     # 2024-01-01 00:00:00 UTC
DENSE_STEP_MICROS = 100000                # 100 ms per record
DENSE_BURST_BLOCK = 600                   # records per minute block
DENSE_BURST_SHIFT_MICROS = 50000          # odd blocks run at double speed
N_SERVICES = 7
SCOPE_NAME = "events"
SCOPE_VERSION = "1.0"


def dense_micros(event_id: str = "event_id") -> Column:
    eid = F.col(event_id)
    odd_block = F.expr(f"({event_id} div {DENSE_BURST_BLOCK}) % 2 = 1")
    shift = F.when(odd_block, (eid % DENSE_BURST_BLOCK) * DENSE_BURST_SHIFT_MICROS).otherwise(F.lit(0))
    return F.lit(DENSE_EPOCH_MICROS) + eid * DENSE_STEP_MICROS - shift


# observed a little after the event, at a nanosecond of its own
OBSERVED_DELAY_MICROS = 250


def severity_number(event_type: Column, event_id: Column) -> Column:
    return (F.when(event_type == "error", 17 + event_id % 8)
            .when(event_type == "purchase", 13 + event_id % 4)
            .when(event_type == "view", 5 + event_id % 4)
            .otherwise(9 + event_id % 4)).cast("int")


def severity_text(event_type: Column, event_id: Column) -> Column:
    return (F.when((event_type == "error") & (event_id % 8 >= 4), F.lit("FATAL"))
            .when(event_type == "error", F.lit("ERROR"))
            .when(event_type == "purchase", F.lit("WARNING"))
            .when(event_type == "view", F.lit("DEBUG"))
            .otherwise(F.lit("INFO")))


def logs_from_events(events: DataFrame, clock: str = "dense", keep: tuple[str, ...] = ()) -> DataFrame:
    """Map ``events`` rows to the logs schema plus ``event_id`` (and the
    input columns named in ``keep``).

    Pure projection: partitioning of the input is kept, nothing shuffles.
    """
    eid = F.col("event_id")
    if clock == "dense":
        micros = dense_micros("event_id")
        ts = F.timestamp_micros(micros)
        nanos = micros * 1000
    elif clock == "wide":
        ts = F.col("ts").cast("timestamp")
        nanos = F.unix_micros(ts) * 1000
    else:
        raise ValueError(f"unknown clock {clock!r}")
    service = F.concat(F.lit("svc-"), (F.col("user_id") % N_SERVICES).cast("string"))
    etype = F.col("event_type")
    out = events.select(
        eid.alias("event_id"),
        ts.alias("ts"),
        nanos.alias("ts_nanos"),
        etype.alias("_etype"),
        F.col("user_id"),
        F.col("props"),
        service.alias("service_name"),
        *keep,
    )
    return out.select(
        "event_id",
        "ts",
        "ts_nanos",
        F.timestamp_micros(F.unix_micros("ts") + OBSERVED_DELAY_MICROS).alias("observed_ts"),
        (F.col("ts_nanos") + OBSERVED_DELAY_MICROS * 1000 + eid % 1000).alias("observed_ts_nanos"),
        F.date_trunc("second", "ts").alias("inserted_at"),
        F.md5(eid.cast("string")).alias("trace_id"),
        F.substring(F.md5(F.concat(F.lit("s"), eid.cast("string"))), 1, 16).alias("span_id"),
        severity_text(F.col("_etype"), eid).alias("severity_text"),
        severity_number(F.col("_etype"), eid).alias("severity_number"),
        "service_name",
        F.concat(F.col("_etype"), F.lit(" by user "), F.col("user_id").cast("string"),
                 F.lit(" "), F.col("props")).alias("body"),
        F.lit(S.BODY_TYPE_STRING).alias("body_type"),
        F.lit(SCOPE_NAME).alias("scope_name"),
        F.lit(SCOPE_VERSION).alias("scope_version"),
        F.array(F.lit("event.type"), F.lit("k")).alias("log_attr_keys"),
        F.array(F.col("_etype"), F.get_json_object("props", "$.k")).alias("log_attr_values"),
        F.array(F.lit(S.SERVICE_NAME_KEY)).alias("res_attr_keys"),
        F.array(F.col("service_name")).alias("res_attr_values"),
        F.to_date("ts").alias("log_date"),
        *keep,
    )


def read_logs(spark: SparkSession, sf_dir: str, clock: str = "dense") -> DataFrame:
    return logs_from_events(read_table(spark, sf_dir, "events"), clock)
