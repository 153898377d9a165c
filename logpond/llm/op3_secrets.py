"""Secret scan with a randomness test battery (DataFrame functions only).

Base spans come from three fixed patterns. Beyond them, every long run of
token characters is taken apart: ``=`` is padding at a token's end and a
separator elsewhere (``NAME=VALUE``), and a token that fits no encoding as it
stands is cut at ``/``, ``+``, ``_`` and ``-``. What fits one (hex, base32,
base36, base64) is put to a battery under the hypothesis that it is random in
its inferred encoding:

* chi-squared test of a uniform alphabet,
* runs test over the halves of the alphabet,
* lag-1 serial correlation of the alphabet positions.

The least p-value, times three, is the token's p-value (Bonferroni). Tokens
that are not random (words, paths, names, counters) are cleared by
Benjamini-Hochberg over all candidates of the corpus, separately for each
length class (pieces shorter than a run have their own), so short tokens, whose tests have little power, do not set the
level of long ones: at most ``FDR`` of the cleared tokens are expected to be
random. What is not cleared becomes a span of kind ``random``.

P-values are kept as steps of 1/100 of a decade, rounded up, so the
procedure needs only a histogram of at most ``LENGTH_CLASSES`` x
``MAX_STEP`` rows, however many candidates there are.

Defined cases: a null or empty text has no spans; repeated rows and null
ids each get their result; an empty table gives an empty result; extra
columns are ignored; positions are code points. A very long text, and one
with very many matches, costs time in proportion: matches become rows, places
are running sums and overlaps are found by a sorted sweep; only the matches of
one text have to fit a task's sort, which spills.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logpond.llm.common import BROADCAST_BYTES, pick, saved

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short holds no longer one, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6

TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}"
#: What lies between the separators of a run, with its padding; a piece that fits no encoding is cut into parts.
PIECE = r"[A-Za-z0-9+/_-]{16,}(?:=+(?![A-Za-z0-9+/_=-]))?"
PART = r"[A-Za-z0-9]{16,}(?:=+(?![A-Za-z0-9+/_=-]))?"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: encoding -> (what the token's body must match, alphabet); the first that fits is inferred
ENCODINGS = {
    "hex": (r"^[0-9a-f]*$", DIGITS + "abcdef"),
    "HEX": (r"^[0-9A-F]*$", DIGITS + "ABCDEF"),
    "base32": (r"^[A-Z2-7]*$", UPPER + "234567"),
    "base36": (r"^[0-9a-z]*$", DIGITS + LOWER),
    "BASE36": (r"^[0-9A-Z]*$", DIGITS + UPPER),
    "base64": (r"^[A-Za-z0-9+/]*$", UPPER + LOWER + DIGITS + "+/"),
    "base64url": (r"^[A-Za-z0-9_-]*$", UPPER + LOWER + DIGITS + "-_"),
}
FDR = 0.05
MAX_STEP = 1200           # p-values below 1e-12 count as 1e-12
LENGTH_CLASSES = 12       # floor(log2(length)), at most this; 3 for pieces of 16 to 23

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _matches(t: Column, pattern: str) -> Column:
    """Every match of ``pattern`` (x) with the number of characters between
    the match before and it (g); the last entry, the text's end, has no x."""
    gap = F.transform(F.split(t, pattern, -1), F.char_length).alias("g")
    zipped = F.arrays_zip(gap, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("x"))
    # most texts hold none and are searched only once; null has no rows
    return F.when(t.rlike(pattern), zipped)


def _placed(rows: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Adds start and end to exploded matches (``keys`` name their text, pos,
    g, x): a running sum over the lengths, whatever their number."""
    so_far = F.sum(F.col("g") + F.char_length("x")).over(
        Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    d = rows.where("x is not null").withColumn("end", (at + so_far).cast("int"))
    return d.withColumn("start", F.col("end") - F.char_length("x"))


def _within(rows: DataFrame, pattern: str) -> DataFrame:
    """row, start, end, x of the matches of ``pattern`` in the texts x of
    ``rows`` (row, start, x)."""
    d = rows.select("row", F.col("start").alias("at"), F.posexplode(_matches(F.col("x"), pattern)).alias("pos", "m"))
    return _placed(d.select("row", "at", "pos", "m.g", "m.x"), ["row", "at"], F.col("at")).select("row", "start", "end", "x")


def _erfc(df: DataFrame, x: str, out: str) -> DataFrame:
    """Adds the complementary error function of column ``x`` >= 0
    (Abramowitz & Stegun 7.1.26)."""
    u = F.col("_u")
    poly = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429))))
    return df.withColumn("_u", 1 / (1 + 0.3275911 * F.col(x))).withColumn(
        out, poly * F.exp(-F.col(x) * F.col(x))).drop("_u")


def _body(x: Column) -> Column:
    return F.regexp_replace(x, "=+$", "")


def _alphabet(body: Column) -> Column:
    """Alphabet of the first encoding that ``body`` fits, or null. An encoded
    token has a letter, a base64 one both cases."""
    alphabet = F.lit(None).cast("string")
    for name, (fits, letters) in reversed(ENCODINGS.items()):
        cond = body.rlike(fits)
        if name.startswith("base64"):
            cond = cond & body.rlike("[A-Z]") & body.rlike("[a-z]")
        alphabet = F.when(cond, F.lit(letters)).otherwise(alphabet)
    return F.when((F.char_length(body) >= 16) & body.rlike("[A-Za-z]"), alphabet)


def _pieces(runs: DataFrame) -> DataFrame:
    """The tokens in ``runs`` that can be tested: what lies between ``=``,
    whole if it fits an encoding, else its parts."""
    pieces = _within(runs, PIECE)
    fits = _alphabet(_body(F.col("x"))).isNotNull()
    return pieces.where(fits).unionByName(_within(pieces.where(~fits), PART))


def encoded(tokens: DataFrame) -> DataFrame:
    """Rows of ``tokens`` (column x) that look encoded, with ``body`` and
    ``alphabet``."""
    return tokens.withColumn("body", _body(F.col("x"))).withColumn(
        "alphabet", _alphabet(F.col("body"))).where("alphabet is not null")


def battery(rows: DataFrame) -> DataFrame:
    """Adds ``p``, the battery's p-value of ``body`` over ``alphabet``.
    Linear in the token's length (times the alphabet's, at most 64)."""
    c = F.col
    d = rows.withColumn("_k", F.char_length("alphabet")).withColumn("_at", F.transform(
        F.filter(F.split("body", ""), lambda ch: ch != ""), lambda ch: F.instr(c("alphabet"), ch) - 1))
    d = d.withColumn("_n", F.size("_at").cast("double"))
    # uniform alphabet; Wilson-Hilferty for the tail
    d = d.withColumn("_sq", F.aggregate(
        F.transform(F.sequence(F.lit(0), c("_k") - 1), lambda j: F.size(F.filter("_at", lambda i: i == j)).cast("double")),
        F.lit(0.0), lambda a, x: a + x * x))
    d = d.withColumn("_dof", (c("_k") - 1).cast("double")).withColumn(
        "_chi", F.greatest(c("_sq") * c("_k") / c("_n") - c("_n"), F.lit(0.0)))
    d = d.withColumn("_zu", (F.pow(c("_chi") / c("_dof"), F.lit(1 / 3)) - (1 - 2 / (9 * c("_dof"))))
                     / F.sqrt(2 / (9 * c("_dof"))))
    # runs of the lower and upper half of the alphabet: changes of half
    half = F.transform("_at", lambda i: i * 2 >= c("_k"))
    d = d.withColumn("_half", half).withColumn("_changes", F.aggregate(
        F.transform(F.slice("_half", F.lit(1), F.size("_half") - 1),
                    lambda h, i: (h != F.get("_half", i + 1)).cast("double")),
        F.lit(0.0), lambda a, x: a + x))
    d = d.withColumn("_zr", (c("_changes") - (c("_n") - 1) / 2) / F.sqrt((c("_n") - 1) / 4))
    # serial correlation with the known mean and variance
    d = d.withColumn("_dev", F.transform("_at", lambda i: i - (c("_k") - 1) / 2))
    d = d.withColumn("_cross", F.aggregate(
        F.transform(F.slice("_dev", F.lit(1), F.size("_dev") - 1), lambda x, i: x * F.get("_dev", i + 1)),
        F.lit(0.0), lambda a, x: a + x))
    d = d.withColumn("_zs", c("_cross") / ((c("_k") * c("_k") - 1) / 12) / F.sqrt(c("_n") - 1))
    for z in ("_zu", "_zr", "_zs"):
        d = _erfc(d.withColumn("_x", F.abs(z) / math.sqrt(2)), "_x", f"{z}p").drop("_x")
    uniform = F.when(c("_zu") >= 0, c("_zup") / 2).otherwise(1 - c("_zup") / 2)
    d = d.withColumn("p", F.least(F.lit(1.0), 3 * F.least(uniform, c("_zrp"), c("_zsp"))))
    return d.drop(*[x for x in d.columns if x.startswith("_")])


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number of its own for each input row), id, th, and the matches
    of each pattern (m0 to m3): the only pass over the texts, written."""
    d = pick(docs, id=id_col, t=text_col).select(
        F.monotonically_increasing_id().alias("row"), "id", F.xxhash64("t").alias("th"), F.coalesce("t", F.lit("")).alias("t"))
    return saved(d.select("row", "id", "th", *[
        _matches(F.col("t"), p).alias(f"m{k}") for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))]), "matches")


def candidates(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base spans: row, start, kind, end; tokens in long runs that overlap
    no base span: row, start, end, x), a row each, both dealt by the text they
    come from. A text's spans are sorted, never compared in pairs."""
    each = [found.select("row", F.lit(k).alias("kind"), F.posexplode(f"m{k}").alias("pos", "m")) for k in range(4)]
    spans = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    spans = spans.select("row", "kind", "pos", "m.g", "m.x").where("x is not null").repartition("row")
    spans = saved(_placed(spans, ["row", "kind"], F.lit(0)), "spans")
    value = F.char_length(F.regexp_extract("x", ASSIGN, 2))
    base = spans.where((F.col("kind") < 3) & ((F.col("kind") > 0) | (value >= ASSIGN_LEAST))).select("row", "start", "kind", "end")
    tokens = _pieces(spans.where("kind = 3").select("row", "start", "x").repartition("row"))
    # a base span that starts before the token's end and ends after its start
    events = base.select("row", F.col("start").alias("at"), F.lit(1).alias("b"), F.col("end").alias("reach"),
                         *[F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("end", "int"), ("x", "string"))])
    events = events.unionByName(tokens.select("row", F.col("end").alias("at"), F.lit(0).alias("b"),
                                              F.lit(None).cast("int").alias("reach"), "start", "end", "x"))
    reach = F.max("reach").over(Window.partitionBy("row").orderBy("at", "b").rowsBetween(Window.unboundedPreceding, 0))
    fresh = events.withColumn("reach", reach).where((F.col("b") == 0) & (F.coalesce("reach", F.lit(0)) <= F.col("start")))
    return base, fresh.select("row", "start", "end", "x")


def judged(tokens: DataFrame) -> DataFrame:
    """row, start, end, cls (length class), step (p-value in steps of 1/100
    decade): a row per encoded token."""
    size = (F.col("end") - F.col("start")).cast("double")
    return battery(encoded(tokens)).select(
        "row", "start", "end",
        F.when(size < 24, F.lit(3)).otherwise(
            F.least(F.lit(LENGTH_CLASSES), F.floor(F.log2(size) + 1e-9).cast("int"))).alias("cls"),
        F.least(F.lit(MAX_STEP), F.floor(-100 * F.log10(F.greatest("p", F.lit(1e-300)))).cast("int")).alias("step"))


def cleared_from(tokens: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """length class -> least step that clears a token as not random
    (Benjamini-Hochberg). The histogram is bounded by its two axes."""
    hist = tokens.groupBy("cls", "step").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cls")
    ranked = hist.withColumn("m", F.sum("n").over(w)).withColumn(
        "k", F.sum("n").over(w.orderBy(F.desc("step"))))
    passing = ranked.where(F.pow(F.lit(10.0), -F.col("step") / 100.0) <= F.col("k") / F.col("m") * fdr)
    return {r["cls"]: r["step"] for r in passing.groupBy("cls").agg(F.min("step").alias("step")).collect()}


def found_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                fdr: float = FDR) -> tuple[DataFrame, DataFrame]:
    """(row, id, th of every input row; row, start, kind, end of every span)."""
    found = matches(docs, id_col, text_col)
    base, tokens = candidates(found)
    tested = saved(judged(tokens), "tokens")
    cleared = F.lit(MAX_STEP + 1)
    for cls, step in sorted(cleared_from(tested, fdr).items()):    # at most LENGTH_CLASSES entries
        cleared = F.when(F.col("cls") == cls, F.lit(step)).otherwise(cleared)
    flagged = tested.where(F.col("step") < cleared).select("row", "start", F.lit(3).alias("kind"), "end")
    return found.select("row", "id", "th"), base.unionByName(flagged)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """id, th (hash of the text), base, spans: arrays of (start, kind index
    of ``KINDS``, end), by start and kind; one row per input row."""
    rows, spans = found_spans(docs, id_col, text_col, fdr)
    span = F.struct("start", "kind", "end")
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("kind") < 3, span))).alias("base"),
                                      F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(SPAN)
    return rows.join(by_row, "row", "left").select("id", "th", F.coalesce("base", none).alias("base"),
                                                   F.coalesce("spans", none).alias("spans"))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _merged(spans: Column) -> Column:
    """Overlapping spans as one; spans that do not overlap are left as they
    are, without a walk."""
    overlap = F.exists(F.transform(spans, lambda s, i: (i > 0) & (s["start"] < F.get(spans, i - 1)["end"])), lambda x: x)
    walked = F.aggregate(spans, F.array().cast(SPAN), lambda a, s: F.when(
        (F.size(a) > 0) & (s["start"] < F.get(a, F.size(a) - 1)["end"]),
        F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), F.struct(
            F.get(a, F.size(a) - 1)["start"].alias("start"), s["kind"].alias("kind"),
            F.greatest(F.get(a, F.size(a) - 1)["end"], s["end"]).alias("end")))).otherwise(F.array_append(a, s)))
    return F.when(overlap, walked).otherwise(spans)


def redact(text: Column, spans: Column, mark: str = "[SECRET]", blocks: Column | None = None) -> Column:
    """``text`` with every span replaced by ``mark``; overlapping ones are
    merged. ``blocks``, a stored column of ``text_blocks``, makes the cost
    linear in a long text: what lies between two spans is then taken from the
    blocks that it touches."""
    def kept(lo: Column, hi: Column) -> Column:
        if blocks is None:
            return F.substr(text, lo + 1, hi - lo)
        first = F.floor(lo / BLOCK).cast("int")
        touched = F.slice(blocks, first + 1, F.floor(hi / BLOCK).cast("int") - first + 1)
        return F.substr(F.array_join(touched, ""), lo - first * BLOCK + 1, hi - lo)

    cut = _merged(spans) if blocks is None else spans
    before = F.transform(cut, lambda s, i: kept(F.when(i > 0, F.get(cut, i - 1)["end"]).otherwise(F.lit(0)), s["start"]))
    tail = kept(F.get(cut, F.size(cut) - 1)["end"], F.char_length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(before, lambda x: F.concat(x, F.lit(mark))), ""), tail)
                  ).otherwise(text)


BLOCK = 1024


def text_blocks(text: Column) -> Column:
    """``text`` in pieces of ``BLOCK`` characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def disjoint(spans: DataFrame) -> DataFrame:
    """row, start, kind, end: overlapping spans of a row as one."""
    w = Window.partitionBy("row").orderBy("start", "end", "kind")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = spans.withColumn("fresh", F.when(F.col("start") < reach, 0).otherwise(1))
    d = d.withColumn("g", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("row", "g").agg(F.min("start").alias("start"), F.min("kind").alias("kind"), F.max("end").alias("end")).drop("g")


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs``, all rows and columns, with every span of the scan replaced
    by a mark and ``chars_col`` (if there is one) renewed for those rows."""
    names = docs.columns
    rows, spans = found_spans(docs, id_col, text_col)
    by_row = disjoint(spans).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    found = rows.join(by_row, "row").groupBy("id", "th").agg(F.first("spans").alias("spans"))
    found = saved(found, "masked").select(F.col("id").alias("_id"), F.col("th").alias("_th"), "spans")
    measured = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("s")).first()
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(text_col)}"
    same = F.col(f"c{names.index(id_col)}").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_th"))
    # the ids and hashes, and 32 bytes a span
    side = F.broadcast(found) if measured["n"] * 64 + measured["s"] * 32 <= BROADCAST_BYTES else found
    d = flat.join(side, same, "left")
    # the blocks are a column of their own, used twice, so that they are made once a row
    d = d.withColumn("_blocks", F.when(F.col("spans").isNotNull(), text_blocks(F.col(text))))
    d = d.withColumn(text, F.when(F.col("spans").isNotNull(), redact(F.col(text), F.col("spans"), blocks=F.col("_blocks")))
                     .otherwise(F.col(text)))
    if chars_col in names:
        chars = f"c{names.index(chars_col)}"
        kind = docs.schema[names.index(chars_col)].dataType
        d = d.withColumn(chars, F.when(F.col("spans").isNotNull(), F.char_length(text).cast(kind)).otherwise(F.col(chars)))
    return d.select(*[f"c{i}" for i in range(len(names))]).toDF(*names)
