"""Balanced label propagation: shards that keep linked documents together
while their row counts stay at most one apart.

Documents are linked through hubs (here: documents of equal text share a
hub). Start: documents are dealt out evenly by rank. Round: every linked
document votes for a shard where its neighbours are, in the first round the
one with most of them; after it, half of the hubs (dealt anew each round) take
any of their shards, so that what could not move one way can be met by what
moves the other way. A shard admits as many as leave it, in swaps and cycles
between shards, and as many more as it can pay for with unlinked documents
(they have no edge to cut). So every round keeps all counts as they were, no
hub comes to a shard where it has not been, and rounds end when no cut edge
can be mended or ``ROUNDS`` is reached.

A hub of more than half a shard always votes for where it has most, and goes
on to another shard when that one had to turn rows away. Votes are
counts by (hub, shard), at most ``shards`` rows a hub however
large it is, joined back to the members; no hub is ever collected and no
pairs are made. Which of the willing documents move is decided by an exact,
distributed rank. The driver sees tables of shards x shards counts.

Law: ``rows``. Defined cases: a null text counts as an empty one (equal
texts, one hub); null ids and repeated rows are documents like any other;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logpond.llm.common import pick, ranked, saved, small_side

SHARDS = 16
ROUNDS = 6


def _flows(wish: dict[tuple[int, int], int], loose: dict[int, int], shards: int):
    """How many linked documents may move along each (from, to), and how many
    loose ones make room: what a shard takes in beyond what leaves it is paid
    with loose documents. Counts only, at most shards x shards."""
    left = {k: n for k, n in wish.items() if n > 0}
    admitted: dict[tuple[int, int], int] = {}

    def admit(edges, n):
        for e in edges:
            admitted[e] = admitted.get(e, 0) + n
            left[e] -= n
            if not left[e]:
                del left[e]

    # swaps and cycles need no room
    for f, t in sorted(left):
        if f < t and (t, f) in left:
            admit([(f, t), (t, f)], min(left[f, t], left[t, f]))
    targets: dict[int, list[int]] = {}
    for f, t in sorted(left):
        targets.setdefault(f, []).append(t)
    order: dict[int, None] = {}     # shards without a way into a cycle, targets before sources
    for root in range(shards):
        path = [] if root in order else [root]
        while path:
            f = path[-1]
            ways = targets.get(f, [])
            while ways and ((f, ways[-1]) not in left or ways[-1] in order):
                ways.pop()
            if not ways:
                order[path.pop()] = None
            elif ways[-1] in path:
                at = path.index(ways[-1])
                cycle = list(zip(path[at:], [*path[at + 1:], ways[-1]]))
                admit(cycle, min(left[e] for e in cycle))
                del path[at + 1:]
            else:
                path.append(ways[-1])
    # no cycle is left: departures and loose documents make room
    room = {s: loose.get(s, 0) for s in range(shards)}
    sources: dict[int, list[int]] = {}
    for f, t in sorted(left):
        sources.setdefault(t, []).append(f)
    for t in order:
        for f in sources.get(t, []):
            n = min(left[f, t], room[t])
            if n > 0:
                admit([(f, t)], n)
                room[t] -= n
                room[f] += n
    net = [0] * shards
    for (f, t), n in admitted.items():
        net[t] += n
        net[f] -= n
    give = [[s, n] for s, n in enumerate(net) if n > 0]
    take = [[s, -n] for s, n in enumerate(net) if n < 0]
    paid: dict[tuple[int, int], int] = {}
    while give and take:
        n = min(give[-1][1], take[-1][1])
        paid[give[-1][0], take[-1][0]] = n
        for side in (give, take):
            side[-1][1] -= n
            if not side[-1][1]:
                side.pop()
    return admitted, paid


def _cuts(flows: dict[tuple[int, int], int], shards: int) -> list[tuple[int, int, int, int]]:
    """(from, first rank, end of ranks, to): which ranks of a shard's loose
    documents move where."""
    out = []
    for f in range(shards):
        at = 0
        for t in range(shards):
            if n := flows.get((f, t), 0):
                out.append((f, at, at + n, t))
                at += n
    return out


def propagate(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """nodes: row (unique), hub (null for unlinked documents), shard (evenly
    dealt) -> row, hub, shard after propagation; the counts per shard are
    kept exactly."""
    nodes = saved(nodes.select("row", "hub", "shard"), "shards")
    # hubs of more than half a shard: fewer than 2 x shards
    big = saved(nodes.where("hub is not null").groupBy("hub").agg(F.count("*").alias("n")).where(
        F.col("n") * (2 * shards) > nodes.count()).select("hub", F.lit(True).alias("big")), "big")
    closed: set[int] = set()
    for turn in range(rounds):
        loose = {r["shard"]: r["n"] for r in
                 nodes.where("hub is null").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        votes = nodes.where("hub is not null").groupBy("hub", "shard").agg(F.count("*").alias("n")).join(
            F.broadcast(big), "hub", "left").withColumn("big", F.coalesce("big", F.lit(False)))
        # most neighbours first; ties go by a hash, so that hubs spread over the shards
        free_choice = ~F.col("big") & F.lit(turn > 0) & (F.pmod(F.xxhash64("hub", F.lit(turn)), F.lit(2)) == 1)
        votes = saved(votes.withColumn("vote", F.struct(
            F.when(free_choice, F.lit(0).cast("long")).otherwise(F.col("n")).alias("n"),
            F.xxhash64("hub", "shard", F.when(F.col("big"), 0).otherwise(turn)).alias("tie"), "shard")), "votes")
        best = votes.where(~(F.col("big") & F.col("shard").isin(sorted(closed)))).groupBy("hub").agg(F.max("vote").alias("best"))
        moves = votes.join(best, "hub").where("vote < best").select(
            F.col("hub").alias("h"), F.col("shard").alias("s"), F.col("best.shard").alias("to"), "n", "big")
        wished = moves.groupBy("s", "to").agg(F.sum("n").alias("n"), F.min("big").alias("big")).collect()
        wish = {(r["s"], r["to"]): r["n"] for r in wished}
        admitted, paid = _flows(wish, loose, shards)
        if not admitted:
            if not closed and all(r["big"] for r in wished):
                break
            closed = set()
            continue
        closed |= {t for (f, t), n in wish.items() if n > admitted.get((f, t), 0)}
        # at most shards x shards rows each
        spark = nodes.sparkSession
        allowed = F.broadcast(spark.createDataFrame(
            [(f, t, n) for (f, t), n in admitted.items()], "shard int, to int, allowed long"))
        cuts = F.broadcast(spark.createDataFrame(_cuts(paid, shards), "f int, lo long, hi long, moved int"))
        linked = nodes.where("hub is not null").join(
            moves, (F.col("hub") == F.col("h")) & (F.col("shard") == F.col("s")), "left").select("row", "hub", "shard", "to")
        willing = ranked(linked.where("to is not null"), ["shard", "to"], ["hub", "row"], "rank").join(
            allowed, ["shard", "to"], "left").select(
            "row", "hub", F.when(F.col("rank") < F.col("allowed"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        free = ranked(nodes.where("hub is null"), ["shard"], ["row"], "rank").join(
            cuts, (F.col("shard") == F.col("f")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left").select(
            "row", "hub", F.coalesce("moved", "shard").alias("shard"))
        nodes = saved(linked.where("to is null").select("row", "hub", "shard").unionByName(willing).unionByName(free),
                      "shards")
    return nodes


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                    rounds: int = ROUNDS) -> DataFrame:
    """id, size, text_crc32, hub (of documents with equal texts), shard,
    slot (gapless from 0 in the shard): one row per input row."""
    d = pick(docs, id=id_col, t=text_col).select("id", F.coalesce("t", F.lit("")).alias("t"))
    base = saved(d.select(
        "id", (F.octet_length("t") + 1).cast("long").alias("size"), F.crc32(F.col("t").cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2("t", 256)).alias("key"), F.monotonically_increasing_id().alias("row")), "texts")
    shared = saved(base.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(
        "key", F.col("key").alias("hub")), "hubs")
    start = ranked(base.select("row", "key", F.lit(0).alias("all")), ["all"], ["row"], "rank")
    nodes = start.join(small_side(shared, shared.count(), 128), "key", "left").select("row", "hub", (F.col("rank") % shards).cast("int").alias("shard"))
    placed = ranked(propagate(nodes, shards, rounds), ["shard"], ["hub", "row"], "slot")
    return base.drop("key").join(placed, "row").select("id", "size", "text_crc32", "hub", "shard", "slot")
