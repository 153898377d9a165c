"""Connected components of an edge table by alternating large-star and
small-star joins (Kiveris et al., 2014).

Every round is two aggregations and two joins, written to the checkpoint
folder; the number of rounds is about log2 of the component size. Nothing is
collected but a row count and a checksum of the edge table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpond.llm.common import saved


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    links = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def roots(edges: DataFrame) -> DataFrame:
    """(u, v) edges of comparable values -> (u, root): for every node that
    is not the smallest of its component, that smallest one. Loops and
    repeated edges are allowed."""
    e = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
              .where("u <> v").distinct(), "edges")
    state = _state(e)
    while state[0]:
        e = saved(_small_star(_large_star(e)), "edges")
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select("u", F.col("v").alias("root"))
