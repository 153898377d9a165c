"""Readers for the parquet input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    """Read ``{sf_dir}/{name}.parquet``; Catalyst prunes columns and pushes
    filters into the scan (also through the repartition below).

    A file with one row group is read by one task. With ``spread_by``, a
    row key, the rows are hash-partitioned on it after the scan, so costly
    per-row work uses every core (hash, not round-robin: a retried task gets
    the same rows)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.repartition(spread_by) if spread_by else df
