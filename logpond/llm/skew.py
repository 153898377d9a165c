"""Many-to-one lookups whose keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are looked up by broadcast: those with more than one
#: row in so many. Any other key has few rows and goes by shuffle.
HOT_KEYS = 1000


def lookup(rows: DataFrame, key: str, table: DataFrame, uses: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row per ``key``, not null) on
    ``key``. ``uses`` is the column of ``table`` that says how many of the
    ``total`` rows have the key; it is dropped. Both frames are read more than
    once and should be written tables; rows with a null key find nothing and
    are not shuffled."""
    names = rows.columns
    found = [c for c in table.columns if c not in (key, uses)]
    limit = total // HOT_KEYS
    # fewer than HOT_KEYS keys can have more than total / HOT_KEYS rows
    hot = F.broadcast(table.where(F.col(uses) > limit).select(F.col(key).alias("_k"), F.lit(True).alias("_hot"), *found))
    split = rows.join(hot, F.col(key) == F.col("_k"), "left").drop("_k")
    done = split.where(F.col("_hot") | F.col(key).isNull()).drop("_hot")
    rest = split.where(F.col("_hot").isNull() & F.col(key).isNotNull()).select(*names).join(
        table.where(F.col(uses) <= limit).drop(uses), key, "left")
    return done.select(*names, *found).unionByName(rest.select(*names, *found))
