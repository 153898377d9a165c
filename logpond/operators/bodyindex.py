"""Substring index of log bodies (F8): which files can hold a search term.

For every file that compaction writes, the trigrams of its lower-cased bodies
are hashed to ``POSITIONS`` bits, kept as bitmaps of ``BITMAP`` bits (a row per
file and bitmap, ``bitmap_construct_agg``, with partial aggregation). A file
can match a term only if the bits of all of the term's trigrams are set, so
the others are not opened; the exact ``ilike`` then judges the rows of the
rest. Files without an index are always read: the index never decides alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITMAP = 8 * 4096             # bits of one bitmap_construct_agg
POSITIONS = 8 * BITMAP
SCHEMA = T.StructType([T.StructField("file", T.StringType()), T.StructField("k", T.IntegerType()),
                       T.StructField("bits", T.BinaryType())])


def _position(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(POSITIONS))


def build(rows: DataFrame) -> DataFrame:
    """``SCHEMA`` from the rows' file and body."""
    # a look-ahead consumes nothing, so matches overlap; linear in the body
    grams = F.regexp_extract_all(F.lower("body"), F.lit("(?s)(?=(...))"), F.lit(1))
    at = rows.select("file", F.explode(grams).alias("g")).select("file", _position(F.col("g")).alias("p"))
    # bitmap_construct_agg sorts its input: it gets each position of a file once
    return at.distinct().groupBy("file", F.floor(F.col("p") / BITMAP).cast("int").alias("k")).agg(
        F.bitmap_construct_agg(F.col("p") % BITMAP).alias("bits"))


def _needed(index: DataFrame, term: str, literal: bool) -> set[int]:
    """The bits that a matching file has. Wildcards end a stretch of text."""
    if not literal and "\\" in term:
        return set()
    lower = index.sparkSession.range(1).select(F.lower(F.lit(term))).first()[0]
    parts = [lower] if literal else re.split("[%_]", lower)
    grams = sorted({p[i:i + 3] for p in parts for i in range(len(p) - 2)})
    if not grams:
        return set()
    found = index.sparkSession.range(1).select(F.transform(F.array(*[F.lit(g) for g in grams]), _position).alias("p"))
    return set(found.first()["p"])


def _has(bits: Column, at: int) -> Column:
    byte = F.conv(F.hex(F.substring(bits, at // 8 + 1, 1)), 16, 10).cast("int")
    return byte.bitwiseAND(F.lit(1 << at % 8)) != 0


def cannot_match(index: DataFrame, term: str, literal: bool = False) -> list[str]:
    """The indexed files without a row that holds ``term`` (file names)."""
    needed = _needed(index, term, literal)
    if not needed:
        return []
    whole = F.lit(True)
    for k in sorted({p // BITMAP for p in needed}):
        mine = F.lit(True)
        for p in sorted(p % BITMAP for p in needed if p // BITMAP == k):
            mine = mine & _has(F.col("bits"), p)
        whole = whole & F.coalesce(F.max(F.when(F.col("k") == k, mine)), F.lit(False))
    return [r["file"] for r in index.groupBy("file").agg(whole.alias("ok")).where("not ok").select("file").collect()]
