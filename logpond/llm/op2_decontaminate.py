"""Benchmark decontamination: a prefix-filtered set join (DataFrame functions
only).

A benchmark item is cut into windows of ``window`` words (a shorter item is
one window). The tokens of a window are its shingles of ``SHINGLE`` words.
For exact containment the necessary prefix of a window, its tokens ordered
by rarity in the corpus, is one token: its rarest one. So

1. one pass over the corpus counts the benchmark's shingles in it;
2. a window with a shingle that never occurs is dropped: it cannot be there;
3. a second pass joins document positions with the rarest shingle of each
   window, applies the positional and length bounds (the window must start
   and end inside the document) and verifies the words themselves.

Document words are never shuffled: the benchmark side is broadcast, in as
many blocks as its measured bytes need (each block is one more pass, so a
benchmark of any size is handled with the same memory, and a very large one
costs as many passes). Which items hold a window is joined after verification.
What is shuffled is verified occurrences and one narrow row per document.

Defined cases: null or empty texts have no words; an item without words has
no window; items with a null id count under the empty string; repeated rows
of a document each get their result; repeated items count once; an empty
benchmark leaves every document clean; empty documents give an empty
result; extra columns are ignored; a long text costs time in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logpond.llm.common import BROADCAST_BYTES, ascii_lower, pick, rows_matching, saved, small_side, split_words

WINDOW = 10
SHINGLE = 3
#: Everything of ASCII but 0-9, A-Z (before lower-casing) and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def _shingle_key(words: Column, at: Column, q: int) -> Column:
    """Hash of the ``q`` words from index ``at`` (0-based)."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(q)])


def item_windows(items: DataFrame, item_id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(distinct windows: wid, w (words), q (shingle size), bytes; which items
    hold them: wid, item (id as text)), saved. A window's id is the digest of
    its words, so a passage that all items share is one row of the first and a
    row an item of the second, never a list."""
    i = pick(items, item=item_id_col, t=text_col)
    i = i.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), words_of(F.col("t")).alias("w"))
    n = F.size("w")
    wins = F.transform(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))),
                       lambda s: F.slice("w", s, F.least(n, F.lit(window))))
    d = i.where(n > 0).select("item", F.explode(wins).alias("w"))
    # words hold no space, so the joined text stands for the list
    text = F.array_join("w", " ")
    d = saved(d.select(F.unhex(F.sha2(text, 256)).alias("wid"), "item", text.alias("text")), "item-windows")
    windows = d.select("wid", "text").distinct().select("wid", F.split("text", " ").alias("w"), (
        F.octet_length("text") + 128 + 32 * F.size(F.split("text", " "))).cast("long").alias("bytes"))
    windows = windows.withColumn("q", F.least(F.size("w"), F.lit(SHINGLE)))
    return saved(windows, "windows"), saved(d.select("wid", "item").distinct(), "members")


def _positions(docs: DataFrame, qs: list[int]) -> DataFrame:
    """id, th, words, pos, key: a row per document word and shingle size.
    ``words`` is only looked into, in the same generated code, and dropped
    before anything is written."""
    d = docs.select("id", "th", F.posexplode("words").alias("pos", "first"), "words")
    n = F.size("words")
    if len(qs) == 1:
        q = qs[0]
        return d.where(F.col("pos") + q <= n).withColumn("key", _shingle_key(F.col("words"), F.col("pos"), q))
    keys = F.array(*[F.when(F.col("pos") + q <= n, F.struct(
        _shingle_key(F.col("words"), F.col("pos"), q).alias("key"), F.lit(q).alias("q"))) for q in qs])
    d = d.withColumn("e", F.explode(keys)).where("e is not null")
    return d.withColumn("key", F.col("e.key"))


def occurrences(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Verified occurrences (id, th, start, len, wid) of ``windows`` in
    ``docs`` (columns id, th, words)."""
    shape = windows.agg(F.collect_set("q").alias("qs"), F.sum(F.size("w") - F.col("q") + 1).alias("tokens")).first()
    qs, tokens = sorted(shape["qs"]), shape["tokens"] or 0
    token = None
    for q in qs:
        def keyed(p: Column, q: int = q) -> Column:
            return F.struct(p.alias("p"), _shingle_key(F.col("w"), p, q).alias("key"))

        part = windows.where(F.col("q") == q).select("wid", F.explode(F.transform(
            F.sequence(F.lit(0), F.size("w") - q), lambda p: keyed(p))).alias("e"))
        token = part if token is None else token.unionByName(part)
    empty = docs.select("id", "th", F.lit(0).alias("start"), F.lit(0).alias("len"),
                        F.lit(b"").alias("wid")).where(F.lit(False))
    if token is None:
        return empty
    token = saved(token.select("wid", "e.p", "e.key"), "tokens")

    # 1: how often each benchmark shingle occurs in the corpus
    spread = _positions(docs, qs).select("key")
    blocks = -(-tokens * 48 // BROADCAST_BYTES)
    counts = None
    for b in range(blocks):
        known = token.select("key").distinct().where(F.pmod(F.hash("key"), F.lit(blocks)) == b)
        part = spread.join(F.broadcast(known), "key", "left_semi").groupBy("key").agg(F.count("*").alias("df"))
        counts = part if counts is None else counts.unionByName(part)
    counts = saved(counts, "rarity")

    # 2: the necessary prefix of each window, rarest token first
    prefix = token.join(counts, "key", "left").groupBy("wid").agg(
        F.min(F.coalesce("df", F.lit(0).cast("long"))).alias("least"),
        F.min(F.struct("df", "key", "p")).alias("t")).where("least > 0")
    probe = saved(prefix.join(windows, "wid").select("wid", "w", "bytes", "t.key", "t.p"), "probe")

    # 3: join, bounds, verification; the bytes of the windows left are summed
    size = probe.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-size // BROADCAST_BYTES))
    start = F.col("pos") - F.col("p")
    found = None
    for b in range(blocks):
        side = F.broadcast(probe.where(F.pmod(F.hash("wid"), F.lit(blocks)) == b).drop("bytes"))
        part = _positions(docs, qs).join(side, "key").where(
            (start >= 0) & (start + F.size("w") <= F.size("words"))
        ).where(F.slice("words", start + 1, F.size("w")) == F.col("w"))
        part = part.select("id", "th", start.alias("start"), F.size("w").alias("len"), "wid")
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, th (hash of the text), n_words, spans (merged array of start word
    and end word), n_hit, items (sorted ids as text): one row per document
    row."""
    d = pick(docs, id=id_col, t=text_col).select("id", F.xxhash64("t").alias("th"), "t")
    worded = d.select("id", "th", words_of(F.col("t")).alias("words"))
    windows, members = item_windows(items, item_id_col, item_text_col, window)
    found = saved(occurrences(worded, windows), "found")
    # a document has at most `window` occurrences a word: bounded by its text
    held = found.select("id", "th", "wid").distinct().join(members, "wid").groupBy(
        F.col("id").alias("id3"), F.col("th").alias("th3")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    occ = found.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("occ"))
    per = occ.join(held, F.col("id").eqNullSafe(F.col("id3")) & (F.col("th") == F.col("th3")))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    n_hit = F.aggregate("occ", zero, lambda a, o: F.struct(
        F.greatest(a["end"], o["start"] + o["len"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), o["start"] + o["len"] - F.greatest(a["end"], o["start"]))).alias("n")))["n"]
    per = per.select(F.col("id").alias("id2"), F.col("th").alias("th2"), "occ", "items", n_hit.alias("n_hit"))
    # letters keep their place under lower-casing, so words can be counted without it
    rows = d.select("id", "th", F.size(split_words(F.coalesce("t", F.lit("")), SEPARATORS)).cast("long").alias("n_words"))
    return rows.join(per, rows["id"].eqNullSafe(per["id2"]) & (rows["th"] == per["th2"]), "left").select(
        "id", "th", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("occ", F.array().cast("array<struct<start:int,len:int>>")).alias("occurrences"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no window of an
    item. Texts are not shuffled when few documents are contaminated: the
    (id, text hash) list of those is small enough for Spark to broadcast."""
    d = pick(docs, id=id_col, t=text_col).select("id", F.xxhash64("t").alias("th"), words_of(F.col("t")).alias("words"))
    found = occurrences(d, item_windows(items, "item_id", "text", window)[0])
    bad = saved(found.select("id", "th").distinct(), "contaminated")
    return rows_matching(docs, id_col, text_col, small_side(bad, bad.count(), 48), "left_anti")
