"""Quality rules as a rule bitmask ledger (DataFrame functions only).

``ledger`` evaluates every rule once per document and stores the
measurements with one bit per failed rule. A policy is a versioned mask:
``apply_policy`` keeps a document when none of the policy's bits is set, so
a new policy needs no second look at the texts. ``ablation`` aggregates the
bits: per rule, how many documents fail it, and how many fail it alone.

Defined cases: a null or empty text has zero words and fails ``few_words``;
repeated rows and null ids stay as they are (nothing is joined); an empty
table gives an empty ledger; extra columns are ignored.

All measurements of a document are made inside its row: no shuffle, and the
cost of a long text is n log n in its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logpond.llm.common import SPACE_CLASS, pick, split_words

#: rule name -> bit
RULES = {
    "few_words": 0,          # n_words < 50
    "repeated_words": 1,     # over half of the words in repeated 3-word windows
    "word_length": 2,        # mean word length under 2 or over 15
    "symbols": 3,            # over 0.3 symbols of #*$%&|<> a word
    "duplicate_lines": 4,    # over 60 % of the lines with words repeat an earlier one
    "capitals": 5,           # over 70 % of the ASCII letters are capitals, 40 letters or more
}
BASE = ("few_words", "repeated_words")

#: policy version -> rules that reject
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "word_length", "symbols"),
    "v2": (*BASE, "word_length", "symbols", "duplicate_lines", "capitals"),
}
DEFAULT_POLICY = "v2"


def mask_of(policy: str) -> int:
    return sum(1 << RULES[r] for r in POLICIES[policy])


def _bit(rule: str, failed: Column) -> Column:
    return F.when(failed, F.lit(1 << RULES[rule]).cast("long")).otherwise(F.lit(0).cast("long"))


def _count_of(text: Column, char_class: str) -> Column:
    """Characters of ``text`` in ``char_class`` (a negated-able class body)."""
    return F.char_length(F.regexp_replace(text, f"[^{char_class}]+", "")).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = pick(docs, id=id_col, t=text_col).select("id", F.coalesce("t", F.lit("")).alias("t"))
    d = d.select(
        "id", "t", split_words(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS[1:-1]}]")).alias("lines"),
    )
    n = F.size("w")
    # 3-word windows by 64-bit hash; equality is only ever asked inside one text
    d = d.select(
        "id", "t", n.cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(
            F.slice("w", F.lit(1), F.greatest(n - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)),
        )).alias("h"),
    )
    has_rep = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("s", F.when(has_rep, F.array_sort(
        F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    d = d.withColumn("p", F.sort_array(F.transform(
        F.filter("s", lambda x, j: F.coalesce(x["h"] == F.get("s", j - 1)["h"], F.lit(False))
                 | F.coalesce(x["h"] == F.get("s", j + 1)["h"], F.lit(False))),
        lambda x: x["i"])))
    rep = F.aggregate(
        F.transform("p", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("p", j + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return d.select(
        "id", "n_words", "word_chars",
        _count_of(F.col("t"), "#*$%&|<>").alias("n_symbols"),
        "n_lines", "n_dup_lines",
        F.coalesce(rep, F.lit(0).cast("long")).alias("n_repeat_words"),
        _count_of(F.col("t"), "A-Z").alias("n_upper"),
        _count_of(F.col("t"), "a-z").alias("n_lower"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, measurements, ``fail_bits`` long: one row per input row."""
    m = measured(docs, id_col, text_col)
    c = F.col
    bits = (
        _bit("few_words", c("n_words") < 50),
        _bit("repeated_words", 100 * c("n_repeat_words") > 50 * c("n_words")),
        _bit("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
        _bit("symbols", 10 * c("n_symbols") > 3 * c("n_words")),
        _bit("duplicate_lines", 10 * c("n_dup_lines") > 6 * c("n_lines")),
        _bit("capitals", (c("n_upper") + c("n_lower") >= 40)
             & (10 * c("n_upper") > 7 * (c("n_upper") + c("n_lower")))),
    )
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return m.withColumn("fail_bits", total)


def apply_policy(led: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with ``kept``: no bit of the policy's mask is set."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0)


def ablation(led: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone (what
    dropping the rule would win back), and the rules it fails together with.
    One aggregation over the ledger; at most 64 result rows."""
    mask = mask_of(policy)
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    names = [r for r in RULES if r in POLICIES[policy]]
    one = led.select(hit.alias("hit")).groupBy("hit").agg(F.count("*").alias("n"))
    per = one.select("n", "hit", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("long").alias("bit")) for r in names])).alias("r"))
    failed = F.col("hit").bitwiseAND(F.col("r.bit")) != 0
    return per.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("hit") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.coalesce(F.bit_or(F.when(failed, F.col("hit"))), F.lit(0).cast("long")).alias("seen_with_bits"),
    )
