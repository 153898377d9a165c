import random

import xxhash
from pyspark.sql import functions as F

from logpond.llm import op4_simhash as op
from logpond.llm.components import roots


def brute_fp(text):
    words = []
    cur = ""
    for ch in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")):
        if ch == " " or "\x09" <= ch <= "\x0d":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += ch
    if cur:
        words.append(cur)
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, max_bits=2):
    n = len(ids)
    comp = list(range(n))
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                a, b = comp[i], comp[j]
                comp = [a if c == b else c for c in comp]
    low = {}
    for i, c in zip(ids, comp):
        if i is not None and (low.get(c) is None or i < low[c]):
            low[c] = i
    return [low.get(c) for c in comp]


TEXTS = ["", None, " \t", "One two", "one TWO", "a b c d e f g h", "a b c d e f g h", "é È\x0bx\x1cy z", "w " * 5000]


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for t in TEXTS + [" ".join(rng.choices(["aa", "Bb", "cé", "d\n"], k=rng.randrange(60))) for _ in range(200)]:
        assert op.simhash(t) & (1 << 64) - 1 == brute_fp(t)


def test_near_duplicates_brute(spark, docs):
    rng = random.Random(2)
    base = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=120)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for k in range(60):
        w = base[k % 12].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "zz"
        rows.append((100 + k, " ".join(w)))
    rows += [(None, base[0]), (100, base[1]), (7, None)]
    got = op.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    fps = [brute_fp(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r["id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=key) == \
        sorted(zip([i for i, _ in rows], fps, want), key=key)


def _classes(spark, fps, max_bits=2):
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    root = {r["u"]: r["root"] for r in roots(op.links(df, max_bits)).collect()}
    return [root.get(f, f) for f in fps]


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_against_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(8)]
    fps = {0}
    for c in centres:
        for _ in range(30):
            x = c
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(_signed(f) for f in fps)
    u = [f & (1 << 64) - 1 for f in fps]
    want = brute_components(list(range(len(u))), u)
    def norm(c):
        return [c.index(x) for x in c]
    assert norm(_classes(spark, fps)) == norm(want)
    monkeypatch.setattr(op, "BUCKET", 3)         # the way of crowded buckets
    assert norm(_classes(spark, fps)) == norm(want)


def test_components_chain_and_loops(spark):
    e = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102), (7, 7), (500, 500)]
    random.Random(4).shuffle(e)
    got = {r["u"]: r["root"] for r in roots(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


def test_empty(spark, docs):
    assert op.near_duplicates(docs([(1, "a")]).where(F.lit(False))).count() == 0
