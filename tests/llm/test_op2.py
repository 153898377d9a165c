import random
import re

from pyspark.sql import functions as F

from logpond.llm import op2_decontaminate as op
from logpond.llm.op2_decontaminate import clean_documents, decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, window=10):
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(window, len(v))
            for win in {tuple(v[s:s + n]) for s in range(len(v) - n + 1)} if v else ():
                for s in range(len(w) - n + 1):
                    if tuple(w[s:s + n]) == win:
                        hit.update(range(s, s + n))
                        ids.add("" if item is None else str(item))
        out.append((i, len(w), len(hit), tuple(sorted(ids))))
    return out


def run(spark, docs, rows, items):
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    return [(r["id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate(docs(rows), it).collect()]


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def material(seed):
    rng = random.Random(seed)
    vocab = ["a", "B", "cé", "É", "x9", "the", "of", "zz"]
    def text(n):
        return " ,".join(rng.choices(vocab, k=n))
    items = [(k, text(rng.choice([1, 2, 3, 9, 10, 11, 25]) if seed % 2 else rng.choice([4, 10, 14, 30]))) for k in range(12)]
    items += [(3, items[3][1]), (None, text(12)), (50, ""), (51, None), (10, items[0][1])]
    rows = []
    for i in range(40):
        t = text(rng.randrange(60))
        if rng.random() < .5:
            t += "; " + (rng.choice(items)[1] or "") + ". " + text(5)
        rows.append((i, t))
    return rows + [(1, rows[1][1]), (2, "other"), (None, items[1][1]), (None, None), (77, ""), (78, "w " * 3000)], items


def test_against_brute_force(spark, docs):
    for seed in (1, 2):
        rows, items = material(seed)
        assert sorted(run(spark, docs, rows, items), key=key) == sorted(brute(rows, items), key=key)


def test_in_blocks(spark, docs, monkeypatch):
    rows, items = material(3)
    monkeypatch.setattr(op, "BROADCAST_BYTES", 4000)      # several passes
    assert sorted(run(spark, docs, rows, items), key=key) == sorted(brute(rows, items), key=key)


def test_empty_sides(spark, docs):
    rows, items = [(1, "a b c"), (2, None)], [(1, "a b")]
    it = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs(rows), it.where(F.lit(False))).collect()
    assert sorted((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == [(1, 3, 0, []), (2, 0, 0, [])]
    assert decontaminate(docs(rows).where(F.lit(False)), it).count() == 0


def test_clean_documents(spark, docs):
    rows, items = material(4)
    it = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = clean_documents(d, it).collect()
    want = [r for r, b in zip(rows, brute(rows, items)) if not b[2]]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_a_window_that_all_items_share(spark, docs):
    passage = "one two three four five six seven eight nine ten"
    items = spark.range(100_000).select(F.col("id").alias("item_id"), F.lit(passage).alias("text"))
    windows, members = op.item_windows(items, "item_id", "text", 10)
    assert windows.count() == 1 and members.count() == 100_000
    got = decontaminate(docs([(1, f"x {passage} y"), (2, "clean"), (3, passage.upper())]), items).collect()
    want = sorted(map(str, range(100_000)))
    assert {r["id"]: (r["n_hit"], list(r["items"]) == want) for r in got} == {1: (10, True), 2: (0, False), 3: (10, True)}
