import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logpond.llm import op8_packing as op
from logpond.llm.queries import vocabulary

TEXTS = [None, "", " ", "Hello World", "a\u0301 \u0301x e\u0301", "tab\tand\x1cctl\x85nel\u2003em", "ΑΣ ΟΔΟΣ Σ", "it's don't 'll",
         "<|endoftext|> x<|startoftext|>y", "x" * 500 + " " + "é" * 90, "123 4５६", "\n\n a  b\r\n", "日本語 テキスト", "word " * 6000]


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(vocabulary())


def test_ids_equal_the_tokenizers(model):
    rng = random.Random(1)
    parts = ["the", "Thing's", " ", "  ", "\n", "é", "\u0301", "İ", "ß", "12", "'s", "\t", "|", "%%", "\u00a0", "Σ", "ﬁ", "<|endoftext|>", ".", ",.", "%%%", "!!", "\u212b", "\u0958", "ǅ", ")", "ª", "Ⅷ"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(500)]
    want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    enc = op.Encoder(vocabulary())
    for _ in range(2):                # cold and warm
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.ids(texts)] == want
    small = op.Encoder(vocabulary())
    op.CACHE_WORDS, kept = 5, op.CACHE_WORDS
    try:
        assert [np.frombuffer(b, "<u4").tolist() for t in texts for b in small.ids([t])] == want
    finally:
        op.CACHE_WORDS = kept


class _Counted:
    """A tokenizer whose full encodings are counted."""

    def __init__(self, model):
        self.whole, self.model, self.parts = model, model.model, []

    def encode_batch_fast(self, parts, **kw):
        self.parts += parts
        return self.whole.encode_batch_fast(parts, **kw)


def test_words_of_letters_take_the_model_alone(model):
    rng = random.Random(4)
    letters = [c for c in map(chr, op.LETTERS) if c.isalpha()]
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 20))) for _ in range(3000)]
    texts += ["".join(c if c.isascii() else "x" for c in t) + rng.choice(op.TAIL) for t in texts[:200]] + letters + ["ΑΣ.", "ǅ!", "Straße,"]
    enc = op.Encoder(vocabulary())
    enc.model = _Counted(enc.model)
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.ids(texts)] == [
        e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    seen = len(enc.model.parts)
    enc.ids(["Crème BRÛLÉE, naïve Ünïted: Привет ΑΣ ΟΔΟΣ the quick Brown fox."])
    assert set(enc.model.parts[seen:]) <= set(",:.")       # single characters, once each


def test_long_parts_are_not_kept(model):
    enc = op.Encoder(vocabulary())
    texts = ["y" * 70 + " z", "y" * 70]
    assert [np.frombuffer(b, "<u4").tolist() for b in enc.ids(texts)] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert set(enc) == {"z"}


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    for trial in range(60):
        cap = rng.choice([10, 50, 300])
        counts = Counter(rng.choice([rng.randint(1, cap), rng.randint(1, max(1, cap // 4)), 1]) for _ in range(rng.randrange(400)))
        plan = op.plan(dict(counts), cap)
        used = Counter()
        for pattern, times in plan:
            assert sum(length * n for length, n in pattern) <= cap and times > 0
            for length, n in pattern:
                used[length] += n * times
        assert used == +counts
        bins, least = sum(t for _, t in plan), -(-sum(k * v for k, v in counts.items()) // cap)
        assert least <= bins <= max(least + 1, least * 1.25 + 2) or max(counts) * 2 > cap


def test_exact_complements_close_gaps():
    assert len(op.plan({7: 1, 3: 1}, 10)) == 1
    assert sum(t for _, t in op.plan({5: 2, 3: 2, 2: 2}, 10)) == 2       # pairs
    assert sum(t for _, t in op.plan({4: 1, 3: 1, 2: 1, 1: 1}, 10)) == 1   # a triple
    assert op.plan({}, 10) == []
    assert op.plan({1: 1_000_000}, 4096) and sum(t for _, t in op.plan({1: 1_000_000}, 4096)) == 245


def test_best_fit(spark, docs, model):
    rng = random.Random(3)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(["thing"] * rng.randrange(200))) for i in range(60)]
    rows += [(3, "Hello World"), (3, "Hello World"), (None, "x"), (None, None)]
    got = op.best_fit(docs(rows), vocabulary(), capacity=128).collect()
    want = Counter()
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        for no, lo in enumerate(range(0, len(ids), 128)):
            p = ids[lo:lo + 128]
            want[i, no, lo, len(p), zlib.crc32(np.array(p, "<u4").tobytes())] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 128
    total = sum(r["length"] for r in got)
    assert len(seqs) <= -(-total // 128) + 1
    assert op.best_fit(docs(rows).where(F.lit(False)), vocabulary()).count() == 0


def test_with_ids(spark, docs, model):
    got = op.best_fit(docs([(1, "hello world")]), vocabulary(), with_ids=True).collect()
    assert got[0]["ids"] == model.encode("hello world", add_special_tokens=False).ids + [1]
