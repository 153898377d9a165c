"""Exact repeated passages by prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words. Writing every suffix of a corpus
out costs many times the corpus, so suffixes are first thinned without loss:

1. Every window chooses an anchor, its ``GRAM``-word sequence with the
   least hash (leftmost of equals). Equal windows choose equal anchors, so a
   window whose anchor hash occurs once in the corpus repeats nowhere.
   Neighbouring windows share anchors: about one hash for 13 words is
   counted and shuffled.
2. Around each anchor that occurs again, the run of windows that chose it is
   cut out as a region, at most ``WINDOW + GRAM_WINDOW - 1`` words.
3. Regions are partitioned by the anchor sequence, the prefix that all their
   anchored suffixes share. Equal regions are counted by a 64-bit digest
   inside their partition, so a passage copied everywhere is one region; only
   regions that share an anchor with different ones go on with their words.
4. In a partition of at most ``GROUP`` regions the suffixes, cut at
   ``WINDOW`` words, are sorted: the subtree in array form. Neighbours that
   agree in all their words lie under an internal node of that depth: a
   repeat. A larger partition is split by longer prefixes of its suffixes,
   ``GROWTH`` words more at a time, until each part fits and gets its tree
   (``_grown``); only suffixes of crowded anchors are written out for that. No
   partition of unbounded size is ever in one task.
5. Repeated windows go back to their documents, overlapping ones merge into
   the maximal repeats, and their words are removed.

Different regions are compared by their words (prefixes that have grown by a
256-bit digest); the digest that merges equal regions is only compared among
regions with one anchor.

Defined cases: a null or empty text has no words; texts under ``WINDOW``
words lose nothing; repeated rows are documents of their own, so a row that
repeats loses all its words if it has a window; null ids count like others;
an empty table gives an empty result; extra columns are ignored; a long text
costs n log(GRAM_WINDOW).
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpond.llm.bloom import thinned
from logpond.llm.common import pick, saved

WINDOW = 35
GRAM = 10
GROUP = 8000              # about 3 MB of regions in one partition
GROWTH = 5                # words that a prefix gains when its partition does not fit
KNOWN_WORDS = 400_000     # words whose hash a Python worker remembers


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()      # ASCII white space


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Index of the least of every ``span`` neighbours, leftmost of equals."""
    val, at, size = h, np.arange(len(h)), 1
    while 2 * size <= span:
        left = val[:-size] <= val[size:]
        val, at = np.where(left, val[:-size], val[size:]), np.where(left, at[:-size], at[size:])
        size *= 2
    rest = span - size
    if rest:
        left = val[:-rest] <= val[rest:]
        at = np.where(left, at[:-rest], at[rest:])
    return at


def anchors(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, end of windows) of every run of windows with one
    anchor; ``words`` has ``window`` words or more."""
    w = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(w) - gram + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j:j + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    at = _least(h, window - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return h[at[first]].view(np.int64), first, np.append(first[1:], len(at))


def _listed(words: list[bytes], window: int, gram: int) -> np.ndarray:
    """Anchor hashes of a document; twice each that returns inside it."""
    if len(words) < window:
        return np.empty(0, np.int64)
    h, n = np.unique(anchors(words, window, gram)[0], return_counts=True)
    return np.concatenate((h, h[n > 1]))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def surveyed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """id, th, n_words, whole (digest of all words), hashes (of anchors): a
    row per document. ``docs``: id, th, t."""
    schema = docs.select("id", "th", F.lit(0).cast("long").alias("n_words"), F.lit("").alias("whole"),
                         F.array(F.lit(0).cast("long")).alias("hashes")).schema

    def each(batches):
        for b in batches:
            n, whole, hashes = [], [], []
            for t in b.column(2):
                words = words_of(t.as_py())
                n.append(len(words))
                whole.append(_digest(words))
                hashes.append(_listed(words, window, gram))
            ends = np.cumsum([0, *map(len, hashes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(
                np.concatenate([*hashes, np.empty(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(whole, pa.string()), lists], names=schema.names)

    return docs.mapInArrow(each, schema)


def _with_text(docs: DataFrame, side: DataFrame) -> DataFrame:
    """``docs`` joined with the written table ``side`` (id2, th2, ...). A
    Bloom filter of the ids wanted goes ahead of the shuffle of the texts."""
    key = F.xxhash64("id", "th")
    keys = side.select(F.xxhash64("id2", "th2").alias("k"))
    few = thinned(docs, key, keys, side.count())
    return few.join(side, few["id"].eqNullSafe(side["id2"]) & (few["th"] == side["th2"])).drop("id2", "th2")


def regions(docs: DataFrame, wanted: DataFrame, window: int, gram: int) -> DataFrame:
    """h, region (its words, joined by spaces), windows, id, th, ats (words where it
    starts): the regions of the anchors listed per document in ``wanted``
    (id2, th2, hs). Equal regions of a document are one row."""
    d = _with_text(docs, wanted).select("id", "th", "t", "hs")
    schema = d.select(F.lit(0).cast("long").alias("h"), F.lit(b"").cast("binary").alias("region"),
                      F.lit(0).alias("windows"), "id", "th",
                      F.array(F.lit(0)).alias("ats")).schema

    def each(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                row, hs, text, windows, ats = [], [], [], [], []
                for k in range(part.num_rows):
                    words = words_of(part.column(2)[k].as_py())
                    h, first, end = anchors(words, window, gram)
                    own: dict[bytes, tuple[int, int, list[int]]] = {}
                    for i in np.flatnonzero(np.isin(h, part.column(3)[k].values.to_numpy())).tolist():
                        a, z = int(first[i]), int(end[i])
                        own.setdefault(b" ".join(words[a:z - 1 + window]), (int(h[i]), z - a, []))[2].append(a)
                    for region, (hash_, size, at) in own.items():
                        row.append(k)
                        hs.append(hash_)
                        windows.append(size)
                        text.append(region)
                        ats.append(at)
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hs, pa.int64()), pa.array(text, pa.binary()), pa.array(windows, pa.int32()), part.column(0).take(row),
                     part.column(1).take(row), pa.array(ats, pa.list_(pa.int32()))], names=schema.names)

    return d.mapInArrow(each, schema)


def subtree(texts: list[bytes], window: int) -> list[int]:
    """Bit j of a region's mask: its window j also starts elsewhere among
    ``texts``. The suffixes are cut at the window's depth and sorted."""
    suffixes = []
    masks = [0] * len(texts)
    for r, text in enumerate(texts):
        ends = [i for i, c in enumerate(text) if c == 32] + [len(text)]
        starts = [0] + [e + 1 for e in ends[:-1]]
        suffixes += [(text[starts[j]:ends[j + window - 1]], r, j) for j in range(len(ends) - window + 1)]
    suffixes.sort()
    for (a, r, j), (b, s, k) in zip(suffixes, suffixes[1:]):
        if a == b:                      # an internal node of the full depth above both leaves
            masks[r] |= 1 << j
            masks[s] |= 1 << k
    return masks


def repeated(found: DataFrame, window: int, group: int, gram: int = GRAM) -> DataFrame:
    """h, rid, mask: repeated windows of the distinct regions of ``found``
    (h, rid, region, windows, ats; rid: a digest of the region).

    Counting takes digests alone. A region that occurs twice is repeated
    whole, and one that is alone with its anchor not at all; only where
    different regions share an anchor their words decide, and only those,
    one of each, are fetched."""
    one = F.lit(1).cast("long")
    kinds = found.groupBy("h", "rid", "windows").agg(F.sum(F.size("ats")).alias("n"), F.min("uid").alias("uid"))
    kinds = saved(kinds, "kinds")
    several = saved(kinds.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "several")
    whole = kinds.where("n > 1").select("h", "rid", (F.call_function("shiftleft", one, F.col("windows")) - 1).alias("mask"))

    firsts = saved(kinds.join(several, "h").select("uid", F.col("h").alias("h2"), "m"), "firsts")
    texts = thinned(found.select("uid", "h", "rid", "region"), F.col("uid"), firsts.select("uid"), firsts.count())
    texts = texts.join(firsts, "uid").drop("uid", "h2")
    few = texts.where(F.col("m") <= group).groupBy("h").agg(F.collect_list(F.struct("rid", "region")).alias("g"))

    def each(batches):
        for b in batches:
            h, rid, mask = [], [], []
            for k in range(b.num_rows):
                members = b.column(1)[k].as_py()
                h += [b.column(0)[k].as_py()] * len(members)
                rid += [x["rid"] for x in members]
                mask += subtree([x["region"] for x in members], window)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(rid, pa.int64()), pa.array(mask, pa.int64())],
                                             names=["h", "rid", "mask"])

    trees = few.mapInArrow(each, "h long, rid long, mask long").where("mask <> 0")

    # crowded partitions: longer prefixes, until a partition fits
    grown = []
    if not several.where(F.col("m") > group).isEmpty():
        w = texts.where(F.col("m") > group).withColumn("w", F.split(F.col("region").cast("string"), " "))
        grown = _grown(w.select("h", "rid", F.posexplode(F.transform(
            F.sequence(F.lit(1), F.size("w") - window + 1), lambda j: F.array_join(F.slice("w", j, F.lit(window)), " "))).alias(
                "j", "suffix")), window, group, gram)
    found_masks = whole.unionByName(trees)
    for part in grown:
        found_masks = found_masks.unionByName(part.select("h", "rid", F.call_function("shiftleft", one, F.col("j")).alias("mask")))
    return found_masks.groupBy("h", "rid").agg(F.bit_or("mask").alias("mask"))


def deep_nodes(suffixes: list[bytes], window: int) -> list[bool]:
    """Whether each suffix (``window`` words) is a leaf under an internal node
    of depth ``window`` in the tree of all of them: the suffixes are sorted,
    the words that neighbours share are their node's depth."""
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    split = [suffixes[k].split(b" ") for k in order]
    deep = [False] * len(suffixes)
    for x, y, a, b in zip(order, order[1:], split, split[1:]):
        depth = next((d for d in range(min(len(a), len(b))) if a[d] != b[d]), min(len(a), len(b)))
        if depth >= window:
            deep[x] = deep[y] = True
    return deep


def _grown(suffixes: DataFrame, window: int, group: int, gram: int) -> list[DataFrame]:
    """(h, rid, j) of the repeated ones among ``suffixes`` (h, rid, j, suffix:
    window j of a region, as text). Suffixes are partitioned by their first
    words, ``GROWTH`` words more in each round: a suffix alone in its partition
    repeats nowhere, a partition of at most ``group`` gets its tree, a larger
    one goes on. When the prefix is the whole window, a partition is one leaf's
    equals: each of them is a repeat, without a tree."""
    size, out, pending = gram, [], saved(suffixes, "suffixes")
    while True:
        size = min(window, size + GROWTH)
        prefix = F.substring_index(F.col("suffix"), " ", size)
        keyed = pending.withColumn("p", F.unhex(F.sha2(F.concat(F.col("h").cast("string"), F.lit(" "), prefix), 256)))
        counted = saved(keyed.groupBy("p").agg(F.count("*").alias("n")).where("n > 1"), "prefixes")
        shared = saved(keyed.join(counted, "p"), "shared-prefixes")
        if size == window:
            out.append(shared.select("h", "rid", "j"))
            return out
        few = shared.where(F.col("n") <= group).groupBy("p").agg(F.collect_list(F.struct("h", "rid", "j", "suffix")).alias("g"))

        def each(batches):
            for b in batches:
                h, rid, j = [], [], []
                for k in range(b.num_rows):
                    members = b.column(0)[k].as_py()
                    for x, deep in zip(members, deep_nodes([x["suffix"].encode("utf-8", "surrogatepass") for x in members], window)):
                        if deep:
                            h.append(x["h"])
                            rid.append(x["rid"])
                            j.append(x["j"])
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(rid, pa.int64()), pa.array(j, pa.int32())],
                                                 names=["h", "rid", "j"])

        out.append(few.select("g").mapInArrow(each, "h long, rid long, j int"))
        pending = shared.where(F.col("n") > group).drop("p", "n")
        if pending.isEmpty():
            return out


def _removed(n: int, ats: pa.ListArray, masks: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a repeated window. ``ats``: where each
    region starts in the document; ``masks``: its repeated windows."""
    counts = np.diff(ats.offsets.to_numpy())
    at = ats.flatten().to_numpy()
    bits = (np.repeat(masks, counts)[:, None] >> np.arange(62)) & 1
    row, j = np.nonzero(bits)
    edge = np.bincount(at[row] + j, minlength=n + 1)[:n + 1] - np.bincount(at[row] + j + window, minlength=n + 1)[:n + 1]
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   gram: int = GRAM, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """id, th, n_words, n_removed, kept_sha256 (of the kept words joined by
    a space): one row per input row. ``with_text``: also ``kept``, those words
    (null where nothing was removed)."""
    d = pick(docs, id=id_col, t=text_col).select("id", F.xxhash64("t").alias("th"), "t")
    survey = saved(surveyed(d, window, gram), "survey")
    hashes = survey.select("id", "th", F.explode("hashes").alias("h"))
    # written first: a join of two plain shuffles, whose hot keys Spark can split
    more = saved(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    again = saved(thinned(hashes, F.col("h"), more, more.count()).join(more, "h", "left_semi").groupBy(
        F.col("id").alias("id2"), F.col("th").alias("th2")).agg(F.collect_set("h").alias("hs")), "returning")
    found = saved(regions(d, again, window, gram).withColumns(
        {"rid": F.xxhash64("region"), "uid": F.monotonically_increasing_id()}), "regions")
    masks = saved(repeated(found, window, group, gram), "masks")
    marks = found.select("h", "rid", "id", "th", "ats").join(masks, ["h", "rid"]).groupBy(
        F.col("id").alias("id2"), F.col("th").alias("th2")).agg(F.collect_set(F.struct("ats", "mask")).alias("marks"))
    touched = _with_text(d, saved(marks, "marks")).select("id", "th", "t", "marks")
    schema = touched.select("id", "th", F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("sha"),
                            F.lit(None).cast("string").alias("kept")).schema

    def each(batches):
        for b in batches:
            n, sha, kept = [], [], []
            for k in range(b.num_rows):
                words = words_of(b.column(2)[k].as_py())
                m = b.column(3)[k].values
                gone = _removed(len(words), m.field("ats"), m.field("mask").to_numpy(), window)
                left = list(compress(words, (~gone).tolist()))
                n.append(int(gone.sum()))
                sha.append(_digest(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                names=schema.names)

    cut = touched.mapInArrow(each, schema).groupBy(F.col("id").alias("id2"), F.col("th").alias("th2")).agg(
        F.first("n_removed").alias("n_removed"), F.first("sha").alias("sha"), F.first("kept").alias("kept"))
    same = survey["id"].eqNullSafe(cut["id2"]) & (survey["th"] == cut["th2"])
    return survey.drop("hashes").join(cut, same, "left").select(
        "id", "th", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("sha", "whole").alias("kept_sha256"), *(["kept"] if with_text else []))
