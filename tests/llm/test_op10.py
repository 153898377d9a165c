import random
import re

from pyspark.sql import functions as F

from logpond.llm import op10_quality_rules as op

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    win = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = set()
    for i, x in enumerate(win):
        if win.count(x) > 1:
            hit |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))


TEXTS = [None, "", " \n\t", "a b", "a b c", "a b c a b c", "x x x x x", "x " * 3000, "é É\x0b\x1cz\n \né É\x0b\x1cz\n#$", "A" * 60,
         "one two three\n" * 30]


def test_measurements(spark, docs):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choices(["aa", "b", "é", " ", " ", "\n", "#", "😀"], k=rng.randrange(150))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(3, "again"), (None, "a b c")]
    got = op.ledger(docs(rows)).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((-1 if r["id"] is None else r["id"], *(r[c] for c in cols)) for r in got) == \
        sorted((-1 if i is None else i, *brute(t)) for i, t in rows)
    for r in got:
        assert bool(r["fail_bits"] & 1) == (r["n_words"] < 50)
        assert bool(r["fail_bits"] & 2) == (100 * r["n_repeat_words"] > 50 * r["n_words"])


def test_policies_and_ablation(spark, docs):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good), (2, "few"), (3, good.upper()), (4, good.replace(" ", " | ")), (5, "x " * 99)]
    led = op.ledger(docs(rows))
    kept = {p: {r["id"] for r in op.apply_policy(led, p).where("kept").collect()} for p in op.POLICIES}
    assert kept == {"base": {1, 3, 4}, "v1": {1, 3}, "v2": {1}}
    rules = {r["rule"]: r for r in op.ablation(led).collect()}
    assert set(rules) == set(op.RULES)
    for name, bit in op.RULES.items():
        bits = [r["fail_bits"] for r in led.collect()]
        assert rules[name]["n_failed"] == sum(b >> bit & 1 for b in bits)
        assert rules[name]["n_failed_alone"] == sum(b == 1 << bit for b in bits)
    assert op.ablation(led.where(F.lit(False))).count() == 0
    assert op.ledger(docs(rows).where(F.lit(False))).count() == 0
