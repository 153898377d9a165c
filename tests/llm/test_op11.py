import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from logpond.llm import op11_prefix_trie as op

SCHEMA = "conv_id long, turn long, role string, text string, Text string, node string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            md = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, md, role, text))
    full = {}
    for c in own:
        own[c].sort()
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full[c] = [x[3:] for x in own.get(base, [])[:h]] + [x[3:] for x in own[c][h:]]
    members = defaultdict(list)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(full[c]) == len(p)))).encode()).hexdigest())
                  for p, m in members.items())


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)


def found(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                              "saved_tokens", "ends_sha256").collect())


def key(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in list(range(0, 12)) + [100, 101, 150, 199, 205, 206, 207, -100, -103, -250]:
        for turn in range(rng.choice([1, 2, 3, 6, 9, 14])):
            rows.append((c, turn, rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "a", "", None])))
    for c in (300, 301, 302, 303):                      # copies of one conversation, longer than several bands
        rows += [(c, turn, "user", "same") for turn in range(40)]
    rows += [(3, None, "user", "first"), (3, 1, "bot", "tie"), (3, 1, "bot", "tie"), (None, 0, "user", "nobody's")]
    return rows


@pytest.mark.parametrize("band", [2, 16])
def test_against_brute_force(spark, band, monkeypatch):
    monkeypatch.setattr(op, "BAND", band)
    monkeypatch.setattr(op, "PIECE", 2)
    rows = conversations(band)
    assert key(found(op.prefix_trie(table(spark, rows)))) == key(brute(rows))


@pytest.fixture()
def ranges_stay_small(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_conversation_over_many_ranges(spark, ranges_stay_small):
    """One conversation holds most of the rows; ranges cut it in pieces."""
    rng = random.Random(5)
    rows = [(c, t, "u", rng.choice("ab")) for c in range(3) for t in range(5)]
    rows += [(100, t, "u", rng.choice("ab")) for t in range(300)] + [(101, t, "u", "b") for t in range(9)]
    assert op.turns(table(spark, rows, 8), "conv_id", "turn", "role", "text").where("conv = 100").select(
        "part").distinct().count() > 1
    assert key(found(op.prefix_trie(table(spark, rows, 8)))) == key(brute(rows))


def test_empty_and_turnless(spark):
    assert found(op.prefix_trie(table(spark, []))) == []
    assert found(op.prefix_trie(table(spark, [(None, 1, "a", "b")]))) == []
    # conversation 105 has no base and loses its only turn when h > 0
    c = next(i for i in range(101, 200) if zlib.crc32(str(i).encode()) % 6)
    got = found(op.prefix_trie(table(spark, [(c, 0, "u", "long " * 100_000)])))
    assert got == brute([(c, 0, "u", "long " * 100_000)]) and len(got) == 1 and got[0][1] == 0
