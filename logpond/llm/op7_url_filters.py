"""URL filter: a blocked Bloom filter in front of an exact hash join
(DataFrame functions only).

A list of canonical urls (host, path), of any length, is matched whole: every
distinct canonical url is tested against the Bloom filter of the list, and
only possible hits go on to the exact join on (host, path), which removes the
false positives. ``repeated_urls`` makes such a list from the pages
themselves: the canonical urls that several pages share.

A rule or site entry (host, path, action) fits its host and every subdomain,
when the url's path starts with the entry's path. For these a url is expanded
to the (host suffix, path prefix) keys that an entry could have, and tested in
the same way; such lists are to have few path lengths.

The filter is blocked: one 64-bit word a block, and all bits of a key lie in
one block, so a probe is one lookup in a table (block, word). Its size is
``BITS_PER_KEY`` bits an entry; it and the entries are broadcast only while
their measured size (for entries the sum of their bytes) is within
``common.BROADCAST_BYTES`` and shuffled beyond.

Defined cases: a null url or one without ``://`` has empty host and path,
fits nothing and is allowed; repeated rows and null ids stay as they are;
of equally long fitting entries (impossible for distinct entries of one url
with the same host) the greater string wins; an empty table gives an empty
result; extra columns are ignored; a very long url is split and compared whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logpond.llm.common import BROADCAST_BYTES, LOWER, UPPER, pick, saved, small_side

BITS_PER_KEY = 16


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/ ? #`` in lower
    case (A-Z), then the path up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def _word(h: Column) -> Column:
    """The bits of a key inside its block: three of 64."""
    one = F.lit(1).cast("long")
    word = None
    for shift in (40, 46, 52):
        b = F.call_function("shiftleft", one, F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
        word = b if word is None else word.bitwiseOR(b)
    return word


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def build_filter(entries: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(table of block and word, number of blocks) for ``n`` entries."""
    blocks = 1 << max(4, math.ceil(math.log2(max(1, n) * BITS_PER_KEY / 64 + 1)))
    h = _key(F.col("e_host"), F.col("e_path"))
    bloom = entries.select(F.pmod(h, F.lit(blocks)).alias("block"), _word(h).alias("word")).groupBy(
        "block").agg(F.bit_or("word").alias("word"))
    return bloom, blocks


def _measured(entries: DataFrame, host: str, path: str) -> tuple[DataFrame, int]:
    """(the entries, as a broadcast if their bytes allow it; their number)."""
    size = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(host) + F.octet_length(path) + 64), F.lit(0))
                       .alias("bytes")).first()
    return (F.broadcast(entries) if size["bytes"] <= BROADCAST_BYTES else entries), size["n"]


def _possible(urls: DataFrame, host: str, path: str, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key the filter does not rule out."""
    h = _key(F.col(host), F.col(path))
    probed = urls.select("*", F.pmod(h, F.lit(blocks)).alias("block"), _word(h).alias("bits"))
    return probed.join(small_side(bloom, blocks, 32), "block").where(
        F.col("word").bitwiseAND(F.col("bits")) == F.col("bits")).drop("block", "bits", "word")


def whole_matches(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of ``urls`` (distinct host, path) that are in ``listed``
    (distinct host, path; written, as it is read more than once)."""
    side, n = _measured(listed.select("host", "path"), "host", "path")
    bloom, blocks = build_filter(listed.select(F.col("host").alias("e_host"), F.col("path").alias("e_path")), n)
    return _possible(urls, "host", "path", bloom, blocks).join(side, ["host", "path"])


def repeated_urls(pages: DataFrame, least: int, url_col: str = "url") -> DataFrame:
    """The canonical urls (host, path) that at least ``least`` pages have."""
    host, path = canonical(F.col("u"))
    p = pick(pages, u=url_col).select(host.alias("host"), path.alias("path")).where("host <> ''")
    return saved(p.groupBy("host", "path").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("host", "path"), "listed")


def matches(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """(host, path) of ``urls`` (distinct) x fitting entries (host, path,
    action). ``entries``: columns host, path, action."""
    e = entries.select(F.col("host").alias("e_host"), F.col("path").alias("e_path"), "action")
    shape = e.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("e_host", r"\."))).alias("labels"),
        F.collect_set(F.char_length("e_path")).alias("lengths"),   # at most one per path length
    ).first()
    n, labels, lengths = shape["n"], shape["labels"] or 1, sorted(shape["lengths"])
    bloom, blocks = build_filter(e, n)
    lab = F.split("host", r"\.")
    u = urls.select("host", "path", lab.alias("lab"))
    size = F.size("lab")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(size, F.lit(labels))),
        lambda k: F.array_join(F.slice("lab", size - k + 1, k), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda x: x <= F.char_length("path")),
        lambda x: F.substr(F.col("path"), F.lit(1), x))
    u = u.select("host", "path", F.explode(suffixes).alias("e_host"), prefixes.alias("pre"))
    u = u.select("host", "path", "e_host", F.explode("pre").alias("e_path"))
    maybe = _possible(u, "e_host", "e_path", bloom, blocks)
    return maybe.select("host", "path", "e_host", "e_path").join(_measured(e, "e_host", "e_path")[0], ["e_host", "e_path"])


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame, urls: DataFrame | None = None,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (the longest fitting entry of ``rules`` as
    host + path, else null), verdict: the rule's action; without a rule
    ``block`` if an entry of ``listed`` fits or the canonical url is one of
    ``urls`` (host, path), else ``allow``."""
    p = pick(pages, id=id_col, u=url_col)
    host, path = canonical(F.col("u"))
    p = p.select("id", host.alias("host"), path.alias("path"))
    both = rules.select("host", "path", "action").unionByName(
        listed.select("host", "path", F.lit("listed").alias("action")))
    # one probe per distinct canonical url: hot urls are collapsed before the join
    distinct = p.select("host", "path").distinct()
    hit = matches(distinct, both).select("host", "path", "e_host", "e_path", "action")
    if urls is not None:
        hit = hit.unionByName(whole_matches(distinct, urls).select("host", "path", F.col("host").alias("e_host"),
                                                                   F.col("path").alias("e_path"), F.lit("listed").alias("action")))
    name = F.concat("e_host", "e_path")
    is_rule = F.col("action") != "listed"
    best = hit.groupBy("host", "path").agg(
        F.max(F.when(is_rule, F.struct(F.char_length(name).alias("len"), name.alias("rule"),
                                       F.col("action").alias("action")))).alias("best"),
        F.max(~is_rule).alias("on_list"))
    return p.join(best, ["host", "path"], "left").select(
        "id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.when(F.col("on_list"), F.lit("block")), F.lit("allow")).alias("verdict"))


def entries_table(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], "host string, path string, action string")
