import random
from itertools import permutations

import numpy as np
import pytest

from logpond.llm import op13_filter_audit as op
from logpond.llm import skew

LABELS = "doc_id long, quality int, toxic int"


def fails(rows, k):
    i, t, _ = rows[k]
    t = t or ""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
    out = set()
    if len(w) < 50:
        out.add("A")
    if 100 * len(set(w)) < 65 * len(w):
        out.add("B")
    if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
        out.add("C")
    if set(t) & set("#$%&*|"):
        out.add("D")
    if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
        out.add("E")
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    f = [fails(rows, k) for k in range(len(rows))]
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [k for k in range(len(rows)) if (rows[k][2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [k for k in left if x in f[k]]
                left = [k for k in left if x not in f[k]]
                total[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(x in f[k] for k in mine) - len(gone), sum(f[k] == {x} for k in mine),
                    sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def found(df):
    return {tuple(r[:3]): tuple(r[3:]) for r in df.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


def sample(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [rng.choice(["stone", "River", "tree", "a#", "B", "paper"]) + rng.choice(["", "x", str(rng.randint(0, 99))])
             for _ in range(rng.choice([0, 10, 49, 50, 60, 120]))]
        t = " ".join(w) if rng.random() < .6 else " ".join(x.lower().strip("#") for x in w)
        rows.append((i, rng.choice(["", None, "same text", t, t, t]), rng.choice(["s1", "s2", None, ""])))
    rows += [(None, "same text", "s1"), (None, "x", None), (3, "same text", "s2"), (3, "same text", "s2"), (n, "Aa " * 100_000, "s9")]
    return rows


@pytest.mark.parametrize("hot", [1000, 4])
def test_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", hot)
    rows = sample(150, hot)
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 150, 2)] + [(4, None, None), (4, 1, 0), (None, 1, 1), (9999, 1, 1)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, part string, n long")
    got = found(op.audit(d.repartition(3), spark.createDataFrame(labels, LABELS)))
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    assert got == brute(rows, labels)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    none = spark.createDataFrame([], LABELS)
    assert op.audit(d.where("false"), none).count() == 0
    assert found(op.audit(d, none)) == brute([(1, None, None)], [])


def test_positional_popcount():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 5, 17, 1000, 4097):
        w = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert op.positional_popcount(w).tolist() == [int(((w >> np.uint32(b)) & 1).sum()) for b in range(32)]


def test_survival_words():
    for f, word in enumerate(op.survival_words().tolist()):
        assert [bool(word >> s & 1) for s in range(32)] == [s & f == 0 for s in range(32)]
