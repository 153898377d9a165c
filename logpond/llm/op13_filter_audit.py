"""Filter interaction audit: truth-table survival words.

Five filters give 32 subsets. A document that fails the filters F survives
exactly the subsets that share none of F, which is one 32-bit word: bit S is
set if the subset S leaves the document. Counting the set bits of each
position over all words of a part gives the survivors of every subset at once,
and everything the audit reports is arithmetic on these 32 numbers: a step of
an order is a subset and one filter more.

The counts are carry-save positional popcounts: words of equal weight are
added three at a time, bit by bit, into a sum and a carry word, so that a
batch of n words becomes about log2(n) words, one per power of two. That is
done per Arrow batch, for all rows of a part and for its good and its toxic
rows; only 32 counts a part and batch are shuffled and added.

Filters (``FILTERS``): A too few words, B too few distinct words, C too many
capitals, D a symbol, E a copy of a text that a smaller id has. A to D need
the text alone and are measured where it is read, in Spark expressions; for E
only digests and ids are shuffled, and digests that many documents share are
looked up by broadcast (``skew.lookup``).

Defined cases: a null or empty text is empty (and fails A; 0 words of 0 do not
fail B); rows that repeat an id are documents of their own, and of equal texts
all rows with the smallest id pass E; a null id has no smaller one and is
smaller than none, and has no labels; several labels of an id count if any is
1; a null part is the empty string; an empty table gives an empty result;
extra columns are ignored; the cost is linear in a text's length, also of very
long ones.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logpond.llm.common import SPACE_CLASS, pick, saved, split_words
from logpond.llm.skew import lookup

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
SYMBOLS = "#$%&*|"


def text_failures(t: Column) -> Column:
    """Filters A to D as bits 0 to 3."""
    words = split_words(t, SPACE_CLASS + "+")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.char_length(t) - F.char_length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < MIN_WORDS, distinct * 100 < n * DISTINCT_PERCENT,
             capitals.cast("long") * 100 > F.char_length(t).cast("long") * CAPITAL_PERCENT,
             t.rlike("[" + SYMBOLS + "]")]
    bits = F.lit(0)
    for k, f in enumerate(fails):
        bits = bits + F.when(f, 1 << k).otherwise(0)
    return bits


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             part_col: str = "source", label_id_col: str = "doc_id") -> DataFrame:
    """part, fails (five bits), good, toxic: one row per document."""
    d = pick(docs, id=id_col, t=text_col, p=part_col).withColumn("t", F.coalesce("t", F.lit("")))
    facts = saved(d.select("id", F.coalesce(F.col("p").cast("string"), F.lit("")).alias("part"),
                           F.sha2(F.col("t"), 256).alias("digest"), text_failures(F.col("t")).alias("bits")), "facts")
    total = facts.count()
    copied = saved(facts.groupBy("digest").agg(F.count("*").alias("uses"), F.min("id").alias("lowest"))
                   .where("uses > 1"), "copied")
    judged = saved(lookup(facts, "digest", copied, "uses", total).select(
        "id", "part", F.when(F.coalesce(F.col("id") > F.col("lowest"), F.lit(False)), F.col("bits") + 16)
        .otherwise(F.col("bits")).alias("fails")), "judged")
    marks = pick(labels, id=label_id_col, q="quality", x="toxic").where("id is not null").groupBy("id").agg(
        F.coalesce(F.max(F.col("q") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("x") == 1), F.lit(False)).alias("toxic"))
    # how many documents have an id matters only to see ids that most rows share
    used = judged.where("id is not null").groupBy("id").agg(F.count("*").alias("uses"))
    labelled = saved(used.join(marks, "id"), "labelled")
    return lookup(judged, "id", labelled, "uses", total).select(
        "part", "fails", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def survival_words() -> np.ndarray:
    """The word of each set of failed filters."""
    s = np.arange(SUBSETS)
    return np.array([sum(1 << int(k) for k in s[(s & f) == 0]) for f in range(SUBSETS)], np.uint32)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the words have each bit, by carry-save addition."""
    out = np.zeros(SUBSETS, np.int64)
    level, weight = words, 1
    while len(level):
        carries = []
        while len(level) > 1:
            k = -(-len(level) // 3)                 # full adders over thirds, the last one filled with zeros
            a, b = level[:k], level[k:2 * k]
            c = np.zeros(k, np.uint32)
            c[:len(level) - 2 * k] = level[2 * k:]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = half ^ c
        out += weight * ((level[0] >> np.arange(SUBSETS, dtype=np.uint32)) & 1).astype(np.int64)
        level = np.concatenate(carries) if carries else level[:0]
        level = level[level != 0]
        weight *= 2
    return out


def survivors(failed: DataFrame) -> DataFrame:
    """part, subset, n, n_good, n_toxic: the documents that each of the 32
    subsets leaves."""
    table = survival_words()

    def each(batches):
        for b in batches:
            if not b.num_rows:
                continue
            parts = b.column(0).dictionary_encode()
            names, at = parts.dictionary.to_pylist(), parts.indices.to_numpy()
            words = table[b.column(1).to_numpy()]
            kinds = [np.ones(len(at), bool), *[b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)]]
            order = np.argsort(at, kind="stable")
            edges = np.searchsorted(at[order], np.arange(len(names) + 1))
            counts = []
            for k in range(len(names)):
                rows = order[edges[k]:edges[k + 1]]
                counts.append(np.stack([positional_popcount(words[rows[kind[rows]]]) for kind in kinds], axis=1))
            n = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x in names for _ in range(SUBSETS)], pa.string()),
                 pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(names))),
                 *[pa.array(n[:, k]) for k in range(3)]], names=["part", "subset", "n", "n_good", "n_toxic"])

    return failed.select("part", "fails", "good", "toxic").mapInArrow(
        each, "part string, subset int, n long, n_good long, n_toxic long").groupBy("part", "subset").agg(
            *[F.sum(c).alias(c) for c in ("n", "n_good", "n_toxic")])


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, filter_order, step and the counts of each step of each order."""
    by_part = survivors(failures(docs, labels, **columns)).groupBy("part").agg(*[
        F.array_sort(F.collect_list(F.struct("subset", c)))[c].alias(c) for c in ("n", "n_good", "n_toxic")])   # 32 entries each
    n = len(FILTERS)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = by_part.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))

    def bit(letter: Column) -> Column:
        out = F.lit(0)
        for k, name in enumerate(FILTERS):
            out = F.when(letter == name, 1 << k).otherwise(out)
        return out

    letter = F.expr("substr(filter_order, step, 1)")
    earlier = F.aggregate(F.sequence(F.lit(0), F.col("step") - 1), F.lit(0), lambda acc, k: acc + F.when(
        k > 0, bit(F.substr("filter_order", k, F.lit(1)))).otherwise(0))
    s = steps.withColumn("before", earlier).withColumn("own", bit(letter)).withColumn(
        "after", F.col("before") + F.col("own"))

    def left(counts: str, subset: Column) -> Column:
        return F.get(F.col(counts), subset)

    removed = left("n", F.col("before")) - left("n", F.col("after"))
    # every subset S without the filter stands before it in |S|! (4 - |S|)! orders
    shapley = F.lit(0).cast("long")
    for subset in range(SUBSETS):
        size = subset.bit_count()
        if size < n:
            times = factorial(size) * factorial(n - 1 - size)
            shapley = shapley + F.when(F.lit(subset).bitwiseAND(F.col("own")) == 0, F.lit(times) * (
                left("n", F.lit(subset)) - left("n", F.lit(subset) + F.col("own")))).otherwise(F.lit(0).cast("long"))
    every = F.lit(SUBSETS - 1)
    return s.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), left("n", F.col("after")).alias("kept"),
        removed.alias("removed"),
        (left("n", F.lit(0)) - left("n", F.col("own")) - removed).alias("redundant"),
        (left("n", every - F.col("own")) - left("n", every)).alias("unique_fails"),
        (left("n_good", F.col("before")) - left("n_good", F.col("after"))).alias("good_lost"),
        (left("n_toxic", F.col("before")) - left("n_toxic", F.col("after"))).alias("toxic_lost"),
        shapley.alias("shapley"))
