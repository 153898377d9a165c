"""Blocked Bloom filter as a small table, to thin the large side of a join
before it is shuffled (DataFrame functions only).

A block is ``WORDS`` 64-bit words in one row, so a probe is one lookup in a
broadcast table. The filter takes ``BITS_PER_KEY`` bits a key up to
``MAX_BYTES`` in all; beyond, it is only less selective. It never loses a
row: the join that follows is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 64
BITS_PER_KEY = 10
MAX_BYTES = 24 << 20


def _probe(h: Column, blocks: int) -> tuple[Column, Column, Column]:
    """(block, word, bits) of a 64-bit key; two bits of one word."""
    mixed = F.xxhash64(h)
    one = F.lit(1).cast("long")
    bits = F.call_function("shiftleft", one, mixed.bitwiseAND(F.lit(63)).cast("int")).bitwiseOR(
        F.call_function("shiftleft", one, F.shiftrightunsigned(mixed, 6).bitwiseAND(F.lit(63)).cast("int")))
    word = F.shiftrightunsigned(mixed, 12).bitwiseAND(F.lit(WORDS - 1)).cast("int")
    return F.shiftrightunsigned(mixed, 20) % blocks, word, bits


def thinned(df: DataFrame, key: Column, keys: DataFrame, n: int) -> DataFrame:
    """Rows of ``df`` whose ``key`` (long) may be among ``keys`` (its first
    column, ``n`` rows, already written). Columns stay as they are."""
    size = min(MAX_BYTES * 8, max(1, n) * BITS_PER_KEY)
    blocks = -(-size // (WORDS * 64))
    block, word, bits = _probe(F.col(keys.columns[0]), blocks)
    words = keys.select(block.alias("_b"), word.alias("_w"), bits.alias("_v")).groupBy("_b", "_w").agg(F.bit_or("_v").alias("_v"))
    rows = words.groupBy("_b").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_v"))).alias("_m"))
    table = rows.select("_b", F.transform(
        F.sequence(F.lit(0), F.lit(WORDS - 1)),
        lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long"))).alias("_words"))
    block, word, bits = _probe(key, blocks)
    probed = df.withColumns({"_b": block, "_w": word, "_v": bits}).join(F.broadcast(table), "_b")
    return probed.where(F.get("_words", F.col("_w")).bitwiseAND(F.col("_v")) == F.col("_v")).select(*df.columns)
