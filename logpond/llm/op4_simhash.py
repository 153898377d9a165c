"""SimHash near duplicates by pigeonhole blocks.

Fingerprints within ``max_bits`` differing bits agree in at least two of
``max_bits + 2`` blocks, so every pair of blocks is a join key: close pairs
meet in a bucket, and the Hamming distance decides. Only distinct
fingerprints are compared, so copies cost nothing, and a bucket never emits
its pairs: it emits the edges of a spanning forest of its true links.

A bucket of over ``BUCKET`` fingerprints takes an exact linear way instead:
the free bits of its members are masked in every choice of ``max_bits``
positions; members equal under a mask are links, at most 2^max_bits of them.

Defined cases: a null or empty text has the fingerprint zero and is linked
like any other; rows with equal ids keep their own fingerprints; null ids
never become a component id unless the whole component has none; an empty
table gives an empty result; extra columns are ignored. A text is hashed in
blocks of shingles, so its length does not matter.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logpond.llm.common import pick, rows_matching, saved, small_side
from logpond.llm.components import roots

BITS = 64
BUCKET = 512          # fingerprints a bucket compares directly
HASH_BLOCK = 1 << 15  # shingles whose bits are unpacked at a time
SEED = 42

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()   # ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    starts = starts[:n].tolist()
    ends = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, HASH_BLOCK):
        raw = b"".join([digest(line[a:b], SEED) for a, b in
                        zip(starts[at:at + HASH_BLOCK], ends[at:at + HASH_BLOCK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, th (hash of the text), fp (signed long): one row per input row."""
    d = pick(docs, id=id_col, t=text_col).select("id", F.xxhash64("t").alias("th"), "t")
    schema = d.select("id", "th", F.lit(0).cast("long").alias("fp")).schema

    def each(batches):
        for b in batches:
            fps = [simhash(t.as_py(), shingle) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=schema.names)

    return d.mapInArrow(each, schema)


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the blocks."""
    n = max_bits + 2
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _part(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _bucket_keys(max_bits: int) -> list[Column]:
    fp = F.col("fp")
    return [F.struct(F.lit(no).alias("no"), _part(fp, *a).alias("a"), _part(fp, *b).alias("b"))
            for no, (a, b) in enumerate(itertools.combinations(_blocks(max_bits), 2))]


def _forest(values: list[int], max_bits: int) -> list[tuple[int, int]]:
    """Edges that join what distance <= max_bits links among ``values``."""
    if len(values) == 2:
        a, b = values
        return [(a, b)] if ((a ^ b) & (1 << BITS) - 1).bit_count() <= max_bits else []
    left, edges = np.array(values, dtype=np.int64).view(np.uint64), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found = left[near]
                left = left[~near]
                edges += [(int(np.int64(x.astype(np.int64))), int(y)) for y in found.view(np.int64)]
                todo += list(found)
    return edges


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(u, v) edges over distinct fingerprints ``fp``; their components are
    those of the graph of all pairs within ``max_bits``."""
    keyed = fps.select("fp", F.explode(F.array(*_bucket_keys(max_bits))).alias("k"))
    many = keyed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    keyed = saved(keyed.join(many, "k"), "buckets")   # members of buckets with company

    buckets = keyed.where(F.col("n") <= BUCKET).groupBy("k").agg(F.collect_list("fp").alias("m")).select("m")

    def each(batches):
        for b in batches:
            e = [x for m in b.column(0) for x in _forest(m.as_py(), max_bits)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in e], pa.int64()), pa.array([x[1] for x in e], pa.int64())], names=["u", "v"])

    small = buckets.mapInArrow(each, "u long, v long")

    # crowded buckets: equal under a mask of max_bits free positions
    fp = F.col("fp")
    cases = []
    for no, (a, b) in enumerate(itertools.combinations(_blocks(max_bits), 2)):
        fixed = set(range(a[0], a[0] + a[1])) | set(range(b[0], b[0] + b[1]))
        masks = [sum(1 << p for p in c) for c in itertools.combinations(sorted(set(range(BITS)) - fixed), max_bits)]
        signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]
        cases.append(keyed.where((F.col("n") > BUCKET) & (F.col("k.no") == no)).select(
            "k", "fp", F.explode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("mask")))
    crowded = cases[0]
    for c in cases[1:]:
        crowded = crowded.unionByName(c)
    cliques = crowded.groupBy("k", "mask", fp.bitwiseAND(F.bitwise_not("mask")).alias("rest")).agg(
        F.collect_set("fp").alias("m")).where(F.size("m") > 1)       # at most 2^max_bits members
    large = cliques.select(F.array_min("m").alias("u"), F.explode("m").alias("v")).where("u <> v")
    return small.unionByName(large)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """id, th (hash of the text), fp, root (a fingerprint that names the
    component), component_id (smallest id reachable over links), n_same (rows
    with the same fingerprint): one row per input row."""
    fp = saved(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = saved(fp.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("n_same")), "fps")
    root = roots(links(distinct.select("fp"), max_bits)).withColumnRenamed("u", "fp")
    classed = distinct.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = classed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = classed.join(lowest, "root").select("fp", "n_same", "root", "component_id")
    return fp.join(classes, "fp").select("id", "th", "fp", "root", "component_id", "n_same")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of every group of near duplicates, all its columns: the row
    with the smallest id; of several rows with that id, the one with the
    smallest text hash; a group without ids keeps one of its rows that way.
    Of wholly equal (id, text) rows one stays."""
    narrow = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    per = narrow.groupBy("root", "id", "th").agg(F.count("*").alias("rows"))
    best = per.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "rows")).alias("b"))
    kept = saved(best.select("b.id", "b.th", "b.rows"), "kept")
    repeated = kept.where("rows > 1")
    once = rows_matching(docs, id_col, text_col, kept.where("rows = 1"), "left_semi")
    if repeated.isEmpty():
        return once
    again = rows_matching(docs, id_col, text_col, small_side(repeated, repeated.count(), 48), "left_semi")
    names = docs.columns
    flat = again.toDF(*[f"c{i}" for i in range(len(names))])
    one = flat.dropDuplicates([f"c{names.index(id_col)}", f"c{names.index(text_col)}"])
    return once.union(one.toDF(*names))
