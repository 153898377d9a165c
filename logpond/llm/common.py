"""Helpers shared by the training-data operators.

Input rules that hold for every operator of this subpackage:

* columns are taken by exact name and position (``pick``), so extra columns,
  also ones whose names clash with an operator's own or differ only in case,
  never matter;
* a null text counts as an empty text; null ids are kept as they are;
* rows that repeat an id are separate rows: results are joined back on the
  id *and* a hash of the text, null-safe;
* intermediate tables go to the folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logpond.session import checkpoint_root, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A table is broadcast only when its measured size is at most this.
BROADCAST_BYTES = 32 << 20

#: ASCII white space of the word rules.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_SPLIT = SPACE_CLASS + "+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """``pick(df, out="name", ...)``: those columns alone, found by exact
    name; a repeated name means its first column."""
    names = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"c{names.index(src)}").alias(out) for out, src in cols.items()])


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: cuts
    the lineage, and lost executors cost nothing that was written."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def use_checkpoint_dir(spark: SparkSession) -> str:
    return checkpoint_root(spark)


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``broadcast`` hint when ``rows`` (measured) times ``row_bytes`` stays
    under the bound; otherwise the plain table, joined by shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII texts take the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, LOWER))


def split_words(c: Column, separators: str = WORD_SPLIT) -> Column:
    """Words between runs of ``separators`` (a pattern)."""
    return F.array_remove(F.split(c, separators), "")


def ranked(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Adds ``out``: a gapless rank from 0 within ``group``, also for groups
    that hold most of the rows. A group is dealt into chunks by a hash of
    ``order``; the chunk sizes (one row per group and chunk) give each chunk
    its first rank, and rows are only sorted inside their chunk."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(max(16, n))).cast("int"))
    keys = [*group, "_chunk"]
    sizes = d.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return d.withColumn("_r", inside - 1).join(first, keys).withColumn(
        out, F.col("_first") + F.col("_r")).drop("_chunk", "_r", "_first")


def rows_matching(docs: DataFrame, id_col: str, text_col: str, decided: DataFrame, how: str) -> DataFrame:
    """``docs``, all its columns, semi- or anti-joined (``how``) on id and
    text with ``decided`` (columns id, th = xxhash64 of the text)."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    side = decided.select(F.col("id").alias("_id"), F.col("th").alias("_th"))
    same = F.col(f"c{names.index(id_col)}").eqNullSafe(F.col("_id")) & (
        F.xxhash64(f"c{names.index(text_col)}") == F.col("_th"))
    return flat.join(side, same, how).toDF(*names)
