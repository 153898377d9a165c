"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logpond.llm import oracles
from logpond.llm.common import load, pick
from logpond.session import payload_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---- 7: URL filters ---------------------------------------------------------

#: The judged rules (host, path, action).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Listed sites: hosts that only carry advertising.
URL_LIST = [(f"{h}.example.{t}", "", "block") for h in ("spam-farm", "free-bets") for t in ("com", "net", "org")]


#: Canonical urls that so many pages share are listed, too: crawler traps.
URL_PAGES = 2


@_query("op7_url_filters", oracles.OP7)
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logpond.llm.op7_url_filters import entries_table, repeated_urls, url_filter
    pages = load(spark, sf_dir, "pages")
    out = url_filter(pages, entries_table(spark, URL_RULES), entries_table(spark, URL_LIST), repeated_urls(pages, URL_PAGES))
    return out.withColumnRenamed("id", "page_id")


# ---- 10: quality rules ------------------------------------------------------

@_query("op10_quality_rules", oracles.OP10)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logpond.llm.op10_quality_rules import apply_policy, ledger, mask_of
    led = apply_policy(ledger(load(spark, sf_dir, "documents")))
    return led.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(mask_of("base")).cast("long")) != 0).alias("base_failed"),
        "kept", "fail_bits")


# ---- 2: benchmark decontamination -------------------------------------------

@_query("op2_decontaminate", oracles.OP2)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logpond.llm.op2_decontaminate import decontaminate
    r = decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return r.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


# ---- 4: SimHash near-dedup --------------------------------------------------

@_query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logpond.llm.op4_simhash import near_duplicates
    r = near_duplicates(load(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id")


# ---- 3: secret scans --------------------------------------------------------

@_query("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logpond.llm.op3_secrets import render, scan
    r = scan(load(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return r.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(render(F.col("base")), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))


# ---- 8: best-fit packing ----------------------------------------------------

def vocabulary() -> str:
    """The public vocabulary file; it lies at the same place on every node."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@_query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logpond.llm.op8_packing import best_fit
    r = best_fit(load(spark, sf_dir, "documents"), vocabulary())
    return r.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# ---- 9: quality classifier --------------------------------------------------

#: Scores from here on count as good.
QUALITY_LEAST = 0.3


@_query("op9_quality_model")
def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logpond.llm.op9_quality_model import quality_scores
    r = quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return r.select(F.col("id").alias("doc_id"), "held_out", "score",
                    (F.col("score") >= QUALITY_LEAST).cast("int").alias("predicted"))


# ---- 1: sharding ------------------------------------------------------------

@_query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logpond.llm.op1_sharding import shard_documents
    r = shard_documents(load(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


# ---- 6: WARC ----------------------------------------------------------------

@_query("op6_warc", oracles.OP6)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logpond.llm.op6_warc import round_trip
    r = round_trip(load(spark, sf_dir, "pages")).where("kind = 'record'")
    return r.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


# ---- 5: substring dedup -----------------------------------------------------

@_query("op5_substrings", oracles.OP5)
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logpond.llm.op5_substrings import remove_repeats
    # texts, regions and partitions of suffixes go to Python in batches bounded by bytes
    r = remove_repeats(load(payload_session(spark), sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


# ---- 11: conversation prefix trie -------------------------------------------

@_query("op11_prefix_trie", oracles.OP11)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logpond.llm.op11_prefix_trie import prefix_trie
    return prefix_trie(load(spark, sf_dir, "conversations"))


# ---- 12: toxicity -----------------------------------------------------------

#: Scores from here on count as toxic.
TOXIC_LEAST = 0.3


@_query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logpond.llm.op12_toxicity import toxicity
    r = toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return r.select(F.col("id").alias("doc_id"), "held_out", "score",
                    (F.col("score") >= TOXIC_LEAST).cast("int").alias("predicted"))


# ---- 13: filter interaction audit -------------------------------------------

@_query("op13_filter_audit", oracles.OP13)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logpond.llm.op13_filter_audit import audit
    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
