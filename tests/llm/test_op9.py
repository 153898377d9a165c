import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logpond.llm import op9_quality_model as op


def sample(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < .8
        w = [rng.choice(["stone", "river", "and", "the", "paper", "tree"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(30, 120))]
        rows.append((i, " ".join(w) + "." if good else " %%% ".join(w).upper()))
        if i % 3:
            labels.append((i, int(good), 0))
    return rows, labels


def test_learns_and_calibrates(spark, docs):
    rows, labels = sample(600)
    rows += [(None, "x"), (1000, ""), (1001, None), (1002, "long words " * 20000), (5, rows[5][1])]
    lab = spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0), (9, 0, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    got = op.quality_scores(docs(rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: not t.startswith(tuple("STONERIVAPHD")) or "%%%" not in t for i, t in rows if i is not None and t}
    own = [r for r in got if r["id"] is not None and r["id"] < 600]
    assert np.mean([(r["score"] >= .3) == truth[r["id"]] for r in own]) > .98
    for r in own:
        assert r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0)
    again = {(r["id"], r["score"]) for r in op.quality_scores(docs(rows), lab).collect()}
    assert again == {(r["id"], r["score"]) for r in got}


def test_held_out_labels_do_not_matter(spark, docs):
    rows, labels = sample(300, 2)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a = op.quality_scores(docs(rows), spark.createDataFrame(labels, schema)).collect()
    b = op.quality_scores(docs(rows), spark.createDataFrame(flipped, schema)).collect()
    assert sorted((r["id"], round(r["score"], 9)) for r in a) == sorted((r["id"], round(r["score"], 9)) for r in b)


def test_no_labels_and_empty(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in op.quality_scores(docs([(1, "a b"), (2, None)]), none).collect()] == [0.5, 0.5]
    assert op.quality_scores(docs([(1, "a")]).where(F.lit(False)), none).count() == 0


def test_keep_quality_keeps_columns(spark):
    rows, labels = sample(300, 3)
    d = spark.createDataFrame([(i, t, "en", {"a": 1}) for i, t in rows], "doc_id long, text string, score string, extra map<string,int>")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = op.keep_quality(d, lab, .3)
    assert kept.schema.names == d.schema.names
    scores = {r["id"]: r["score"] for r in op.quality_scores(d, lab).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, s in scores.items() if s >= .3)


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = rng.integers(1, 12)
        total = rng.integers(0, 5, n)
        ones = np.array([rng.integers(0, t + 1) for t in total])
        got = op.isotonic(ones, total)
        assert (np.diff(got) >= -1e-12).all()
        at = np.flatnonzero(total)
        if len(at):     # min-max formula
            want = [max(min(ones[j:k + 1].sum() / total[j:k + 1].sum() for k in at[at >= i]) for j in at[at <= i]) for i in at]
            assert np.allclose(got[at], want)


def test_normal_equations_match_direct_fit(spark, docs):
    rows, labels = sample(200, 5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    stats = op.measured(docs(rows), "doc_id", "text")
    m = op.fit(stats, lab)
    text = dict(rows)
    y = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5]
    z = m.mapped(np.array([op.statistics(text[i]) for i, _ in y]))
    ridge = op.RIDGE * np.eye(z.shape[1])
    ridge[-1, -1] = 0
    w = np.linalg.solve(z.T @ z + ridge, z.T @ np.array([q for _, q in y], float))
    assert m.weights == pytest.approx(w, abs=1e-5)
