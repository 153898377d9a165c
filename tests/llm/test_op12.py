import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logpond.llm import op12_toxicity as op

LABELS = "doc_id long, quality int, toxic int"
STEMS = ["grumblex", "vortiq", "snarfel"]


def corpus(n, seed=1, start=0):
    """Clean prose; toxic documents hold one or two words of a stem with an
    ending that is made anew each time."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word(k):
        return "".join(rng.choice(letters) for _ in range(k))

    plain = [word(rng.randint(2, 8)) for _ in range(200)]
    rows, labels = [], []
    for i in range(start, start + n):
        toxic = rng.random() < .25
        w = [rng.choice(plain) for _ in range(rng.randint(5, 400))]
        if toxic:
            for _ in range(rng.randint(1, 2)):
                w.insert(rng.randint(0, len(w)), rng.choice(STEMS) + word(3))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus(1200)
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    return rows, labels, d, op.toxicity(d, spark.createDataFrame(labels, LABELS)).collect()


def test_unseen_misspellings_of_held_out_documents(fitted):
    rows, labels, _, got = fitted
    truth = {i: x for i, _, x in labels}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2)
    held = [r for r in got if r["held_out"]]
    caught = [r["score"] >= .3 for r in held if truth[r["id"]]]
    alarms = [r["score"] >= .3 for r in held if not truth[r["id"]]]
    assert np.mean(caught) > .9 and np.mean(alarms) < .05


def test_odd_rows(spark, docs):
    rows, labels = corpus(300, 3)
    more = [(None, "x"), (9000, ""), (9001, None), (9002, "word " * 300_000), (9003, "y" * 3_000_000), rows[5]]
    lab = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None), (9, 0, 1), (9, 0, 0)], LABELS)
    got = op.toxicity(docs(rows + more), lab).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["id"] in (9000, 9001)}) == 1
    assert len({r["score"] for r in got if r["id"] == rows[5][0]}) == 1


def test_held_out_labels_do_not_matter(spark, docs):
    rows, labels = corpus(200, 4)
    flipped = [(i, q, 1 - x if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, q, x in labels]
    a, b = (op.toxicity(docs(rows), spark.createDataFrame(x, LABELS)).collect() for x in (labels, flipped))
    assert sorted((r["id"], r["score"]) for r in a) == sorted((r["id"], r["score"]) for r in b)


def test_one_class_none_and_empty(spark, docs):
    d = docs([(i, "a b") for i in range(20)])
    for x, want in ((1, 1.0), (0, 0.0)):
        lab = spark.createDataFrame([(i, 1, x) for i in range(20)], LABELS)
        assert {r["score"] for r in op.toxicity(d, lab).collect()} == {want}
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in op.toxicity(d, none).collect()} == {0.0}
    assert op.toxicity(d.where(F.lit(False)), none).count() == 0


def test_slices_lose_no_word(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("aB \n\t") for _ in range(5000))
    for size in (1, 7, 100, 10_000):
        monkeypatch.setattr(op, "SLICE", size)
        parts = list(op.slices(text))
        assert [w for p in parts for w in p] == text.lower().split()
        assert all(len(p) % op.WINDOW == 0 for p in parts[:-1])
    assert list(op.slices(None)) == list(op.slices("")) == []


def test_ngrams_one_by_one():
    words = ["cat", "", "naïve!", "x" * 40]
    bucket, of = op.ngrams(words)
    for k, w in enumerate(words):
        alone, _ = op.ngrams([w])
        assert sorted(bucket[of == k]) == sorted(alone)
        m = len(w.strip(op.EDGES)) + 2
        assert (of == k).sum() == sum(max(0, m - n + 1) for n in range(op.NGRAMS[0], op.NGRAMS[1] + 1))


def test_the_sample_is_bounded(spark, docs, monkeypatch):
    rows, labels = corpus(200, 7)
    monkeypatch.setattr(op, "TRAIN_TOXIC", 10)
    monkeypatch.setattr(op, "TRAIN_CLEAN", 20)
    lab = spark.createDataFrame(labels, LABELS)
    args = (docs(rows), lab, "doc_id", "text", "doc_id", "toxic")
    got = op.sample(*args).collect()
    assert sum(r["y"] for r in got) == 10 and len(got) == 30
    monkeypatch.setattr(op, "TRAIN_BYTES", 2000)
    assert sum(len(r["t"]) for r in op.sample(*args).collect()) <= 2000
