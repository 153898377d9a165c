"""The pipeline's stages against brute force on a small table with planted
cases: junk, near copies, benchmark passages, secrets."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from logpond.llm import op4_simhash as op4
from logpond.llm.queries import vocabulary
from tests.llm.test_op2 import brute as brute_hits
from tests.llm.test_op3 import brute_base
from tests.llm.test_op4 import brute_components, brute_fp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    vocab = [a + b for a in ("stone", "river", "paper", "tree", "wind", "and", "the") for b in ("", "s", "ed", "ing", "ly")]
    def prose(n):
        return ". ".join(" ".join(rng.choices(vocab, k=12)) for _ in range(n // 12 + 1)) + "."
    items = [(k, prose(30)) for k in range(5)]
    rows, labels = [], []
    for i in range(300):
        junk = i % 6 == 0
        t = " | ".join(rng.choices(vocab, k=60)) + " %%% $$$" if junk else prose(rng.randint(60, 200))
        if i % 11 == 5:
            t += " " + rng.choice(items)[1]
        if i % 13 == 4:
            t += " token = \"" + "".join(rng.choices("0123456789abcdef", k=40)) + "\""
        rows.append((i, t))
        if i % 2:
            labels.append((i, 0 if junk else 1, 0))
        elif junk:
            labels.append((i, 0, 0))
    base = [t for _, t in rows]
    rows += [(1000 + k, base[k * 7 + 1] if k % 2 else base[k * 7 + 1] + " more") for k in range(20)]
    rows += [(1000, rows[300][1]), (None, base[1]), (None, None), (2000, None), (2001, "")]
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, items


def test_every_stage(spark, tables, tmp_path):
    d, items = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality classifier", "near-dedup", "decontamination", "secret scan", "packing"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    before = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=key)
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
            after = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=key)
        if name == "quality classifier":
            gone = [x for x in before if x not in after]
            prose = [(i, t) for i, t in before if i is not None and i < 300 and i % 6]
            assert all(x in after for x in prose)
            assert sum(i is not None and i < 300 and i % 6 == 0 for i, _ in gone) >= 48
        elif name == "near-dedup":
            comp = brute_components([i for i, _ in before], [brute_fp(t) for _, t in before])
            want = {}
            for (i, t), c in zip(before, comp):
                if i == c and c not in want:
                    want[c] = (i, t)
            kept = dict.fromkeys(i for i, _ in after)
            assert set(kept) == set(want) and len(after) == len(want)
        elif name == "decontamination":
            hits = brute_hits(before, items)
            assert after == [x for x, h in zip(before, hits) if not h[2]]
        elif name == "secret scan":
            assert [i for i, _ in after] == [i for i, _ in before]
            for (i, t), (_, u) in zip(before, after):
                spans = brute_base(t)
                if spans:
                    assert "[SECRET]" in u and not brute_base(u)
                else:
                    assert t == u
            assert any(brute_base(t) for _, t in before)
            assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
        else:
            from tokenizers import Tokenizer
            m = Tokenizer.from_file(vocabulary())
            got = docs.collect()
            total = sum(len(m.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in before)
            assert sum(r["length"] for r in got) == total
            assert {r["doc_id"] for r in got} == {i for i, _ in before}
            assert len({r["sequence_id"] for r in got}) <= -(-total // 4096) + 1
        before = after
    ids = lambda rows: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)
    assert ids(P.run(spark, d).collect()) == ids(docs.collect())


def test_empty_table(spark, tables, tmp_path):
    d, _ = tables
    empty = spark.read.parquet(f"{d}/documents.parquet").where(F.lit(False))
    for k, (_, stage) in enumerate(P.STAGES):
        assert stage(spark, empty, d).count() == 0


def test_one_of_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "other words here now"), (5, "x y z"), (5, "x y z"),
                                (6, "x y z")], "doc_id long, text string")
    got = sorted(map(tuple, op4.keep_one_of_each(df).collect()), key=str)
    assert got == sorted([(None, "a b c d"), (None, "other words here now"), (5, "x y z")], key=str)


def test_clashing_columns(spark, tables):
    d, _ = tables
    rows = [(1, "a b c", "en", "s", 5, "T", "th", 7), (1, "a b c", "en", "s", 5, "T", "th", 7), (None, None, None, None, None, None, None, None),
            (2, "token=abcdefgh", None, "s", 14, "T", "spans", 8)]
    docs = spark.createDataFrame(rows, SCHEMA + ", Text string, th string, c0 int")
    for name, stage in P.STAGES:
        got = stage(spark, docs, d)
        if name != "packing":
            assert got.columns == docs.columns
        assert got.count() == {"near-dedup": 3, "packing": 4}.get(name, got.count())
