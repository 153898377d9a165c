"""Error-rate threshold bands.

A band table is user configuration; ``threshold_violations`` checks it (the
editor takes ``MAX_THRESHOLD_BANDS`` rows, the lookup any number). The lookup
is compiled into
one ``CASE WHEN`` over the bands, highest ``min`` first: no join at all,
evaluated inside whole-stage codegen on the rates table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logpond import schema as S

BANDS_DDL = "min int, colour string, label string"


def default_bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(b) for b in S.DEFAULT_THRESHOLDS], BANDS_DDL)


def threshold_violations(bands: DataFrame) -> DataFrame:
    """One row per violation (band_min, label, problem). Checks: min in
    0-100, no duplicate min, non-blank label, ``#rrggbb`` colour, one band at
    0, at most seven bands. An empty result means the table is valid."""
    w = Window.partitionBy("min")
    b = bands.withColumn("_dups", F.count(F.lit(1)).over(w))
    per_row = b.select("min", "label", (
        F.when((F.col("min") < 0) | (F.col("min") > 100), F.lit("Must be 0–100"))
        .when(F.col("_dups") > 1, F.lit("Duplicate value"))
        .when(F.trim(F.coalesce("label", F.lit(""))) == "", F.lit("Label required"))
        .when(~F.coalesce(F.col("colour"), F.lit("")).rlike(S.HEX_COLOUR_PATTERN), F.lit("Invalid colour"))
    ).alias("problem")).filter(F.col("problem").isNotNull())
    summary = bands.agg(
        F.count_if(F.col("min") == 0).alias("_zero"), F.count(F.lit(1)).alias("_n"),
        F.min_by(F.struct("min", "label"), "min").alias("_low"))
    no_zero = summary.filter((F.col("_zero") == 0) & (F.col("_n") > 0)).select(
        F.col("_low.min").alias("min"), F.col("_low.label").alias("label"),
        F.lit("One band must start at 0").alias("problem"))
    too_many = summary.filter(F.col("_n") > S.MAX_THRESHOLD_BANDS).select(
        F.lit(None).cast("int").alias("min"), F.lit(None).cast("string").alias("label"),
        F.lit(f"At most {S.MAX_THRESHOLD_BANDS} bands").alias("problem"))
    return per_row.unionByName(no_zero).unionByName(too_many)


def _band_list(bands) -> list[tuple[int, str, str]]:
    if isinstance(bands, DataFrame):
        # configuration entered by hand: a handful of rows
        rows = bands.select("min", "colour", "label").collect()
        return [(int(r["min"]), r["colour"], r["label"]) for r in rows]
    return [tuple(b) for b in bands]


def band_columns(rate: Column, bands) -> tuple[Column, Column]:
    """(colour, label) of the highest band whose ``min`` <= rate."""
    colour = F.lit(S.DEFAULT_BAND_COLOUR)
    label = F.lit(None).cast("string")
    for mn, col, lab in sorted(_band_list(bands), key=lambda b: b[0]):
        hit = rate >= F.lit(mn)
        colour = F.when(hit, F.lit(col)).otherwise(colour)
        label = F.when(hit, F.lit(lab)).otherwise(label)
    return colour, label


def error_rate_band(rates: DataFrame, bands, rate_col: str = "error_rate") -> DataFrame:
    """Add ``band_colour`` and ``band_label`` to each rate row."""
    colour, label = band_columns(F.col(rate_col), bands)
    return rates.withColumn("band_colour", colour).withColumn("band_label", label)
