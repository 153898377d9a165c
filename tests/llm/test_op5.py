import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from logpond.llm import op5_substrings as op
from logpond.llm.queries import QUERIES


def brute(rows, window):
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[s:s + window]) for w in texts for s in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, texts):
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s:s + window])] > 1:
                gone.update(range(s, s + window))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def material(seed):
    rng = random.Random(seed)
    def text(n, vocab=400):
        return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))
    passage = [text(n) for n in (12, 13, 20, 30, 60)]
    rows = []
    for i in range(60):
        t = text(rng.randrange(80))
        for _ in range(rng.randrange(3)):
            t += rng.choice([" ", "\n", "\t"]) + rng.choice(passage) + " " + text(rng.randrange(20))
        rows.append((i, t))
    rows += [(100, rows[3][1]), (100, rows[3][1]), (101, "x " * 400), (102, "a b " * 100), (103, "é É " * 3), (None, None),
             (None, passage[4]), (104, ""), (105, text(3000, 3)), (4, text(50))]
    return rows


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def run(docs, rows, **kw):
    got = op.remove_repeats(docs(rows), **kw).collect()
    return sorted(((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=key)


def test_against_brute_force(spark, docs):
    rows = material(1)
    want = sorted(brute(rows, 12), key=key)
    assert run(docs, rows, window=12, gram=4) == want
    assert run(docs, rows, window=12, gram=4, group=1) == want        # crowded partitions


def test_prefixes_grow_until_a_partition_fits(spark, docs, monkeypatch):
    monkeypatch.setattr(op, "GROWTH", 3)
    rng = random.Random(9)
    # one anchor-rich phrase in front of many different continuations
    head = " ".join(f"h{k}" for k in range(8))
    rows = [(i, f"{head} " + " ".join(f"{rng.choice('ab')}{k}" for k in range(8)) + f" end{i}") for i in range(120)]
    want = sorted(brute(rows, 12), key=key)
    for group in (1, 6, 40):
        assert run(docs, rows, window=12, gram=4, group=group) == want


def test_deep_nodes():
    rng = random.Random(10)
    for _ in range(50):
        s = [b" ".join(rng.choice([b"a", b"ab", b"b"]) for _ in range(4)) for _ in range(rng.randrange(1, 40))]
        n = Counter(s)
        assert op.deep_nodes(s, 4) == [n[x] > 1 for x in s]


def test_contract_window(spark, docs):
    rows = material(2)
    assert run(docs, rows) == sorted(brute(rows, 35), key=key)


def test_least_is_leftmost():
    rng = np.random.default_rng(0)
    for span in (1, 2, 3, 8, 26):
        h = rng.integers(0, 5, 200).astype(np.uint64)
        got = op._least(h, span)
        assert got.tolist() == [s + int(np.argmin(h[s:s + span])) for s in range(len(h) - span + 1)]


def test_empty(spark, docs):
    assert op.remove_repeats(docs([(1, "a")]).where(F.lit(False))).count() == 0
    assert run(docs, [(1, None), (2, "a b")]) == sorted(brute([(1, None), (2, "a b")], 35), key=key)


def test_query_hands_python_bounded_batches(spark, tmp_path, monkeypatch):
    # texts of 40 KB each: a batch of 10,000 rows would be the whole table
    rows = [(i, " ".join(f"{chr(97 + (i * 7 + k) % 26)}{i}w{k}" for k in range(4000))) for i in range(90)] + [(90, "p q " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = f"{tmp_path}/sizes"
    survey = op.surveyed

    def watched(d, window, gram):
        def each(batches):
            for b in batches:
                with open(sizes, "a") as f:
                    print(b.num_rows, b.nbytes, file=f)
                yield b
        return survey(d.mapInArrow(each, d.schema), window, gram)

    monkeypatch.setattr(op, "surveyed", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = QUERIES["op5_substrings"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(brute(rows, 35))
    seen = [tuple(map(int, x.split())) for x in open(sizes)]
    assert sum(n for n, _ in seen) >= len(rows) and max(n for n, _ in seen) <= 64 and max(b for _, b in seen) <= 2 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
