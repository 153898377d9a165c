"""Conversation prefix trie with a depth-band rollup.

Every distinct sequence of first turns of the (rebuilt) conversations is a
node. A prefix is named by sums: a turn gives four numbers from the MD5 of its
place, role and text, and a prefix is the MD5 of its depth and of the sums of
its turns' numbers. Sums can be taken in pieces, so a conversation that holds
most of the rows is spread over many tasks: turns are dealt by ranges of
(conversation, turn), each range sums its own, and the sums of whole ranges
(one row per conversation and range) are added afterwards.

Subtree totals are rolled up by bands of ``BAND`` depths. The path of a
conversation through a band is one short array; the values of the nodes that
the conversation stands for are added up along it from below, and one row per
node of the path goes to the ancestors within the band. The totals that arrive
at the bands' roots belong to a trie that is ``BAND`` times less deep; it is
rolled up in the same way, and its completed totals are handed down to the
nodes of the band above each root. The rounds grow with the logarithm of the
deepest conversation, the rows with the turns, whatever the shape of the trie.

The digest of a node's ending members is of one text by definition, so its
bytes pass one hash state in order; ids are first joined into pieces of
``PIECE`` within ranges, and a task holds one piece at a time.

Rebuilding (``rebuilt``): conversation c takes the first h turns of
conversation c - c % ``BLOCK``, where h is crc32 of c in decimal modulo
``HEAD``, and goes on with its own turns after its first h.

Defined cases: turns are ordered by turn, null first, then by the MD5 of role
and text (rows equal in all of these are equal turns, in any order); a null
role or text is empty, and a very long one only passes through MD5; rows
without a conversation id belong to none and are left out; ``%`` takes the
sign of the id, as in SQL; a turnless rebuilt conversation ends at the root;
an empty table gives no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logpond.llm.common import pick, saved
from logpond.llm.skew import lookup

BAND = 16
BLOCK, HEAD = 100, 6
PIECE = 4096
SUMS = ("s0", "s1", "s2", "s3")


def turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, part, rank (from 1 within conv and part), md (MD5 of role and
    text), chars: dealt by ranges and written, so that all readers see the
    same ranges."""
    c = pick(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv is not null")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = c.select(
        "conv", "turn", F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("md"),
        F.char_length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("place"))
    # the place only splits runs of rows that are equal in all else
    keys = ["conv", F.col("turn").asc_nulls_first(), "md", "place"]
    dealt = saved(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "turns")
    inside = Window.partitionBy("part", "conv").orderBy(*keys[1:])
    return saved(dealt.withColumn("rank", F.row_number().over(inside).cast("long")).select(
        "conv", "part", "rank", "md", "chars"), "ranked")


def numbers(place: Column, md: Column) -> list[Column]:
    """Four numbers below 2^32 from a turn and its place in the conversation."""
    h = F.md5(F.concat(place.cast("string"), F.lit(":"), md).cast("binary"))
    return [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def node_name(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(":", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary"))


def _total(array, number) -> Column:
    """The sum of ``number`` over an array's entries."""
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + number(x))


def _before(group: str) -> Window:
    return Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """conv, depth, node, parent, chars, last: the path of each rebuilt
    conversation, from the root (depth 0, no parent) on."""
    own = turns(conversations, conv_col, turn_col, role_col, text_col)
    # one row per conversation and range; a conversation's ranges are few
    pieces = own.groupBy("conv", "part").agg(F.count("*").alias("n"))
    pieces = pieces.withColumn("start", F.coalesce(F.sum("n").over(_before("conv")), F.lit(0).cast("long")))
    block = F.col("conv") - F.col("conv") % BLOCK
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD

    # the first turns of the conversations that others begin with
    bases = own.where(F.col("conv") % BLOCK == 0).join(
        pieces.where(F.col("conv") % BLOCK == 0).select("conv", "part", "start"), ["conv", "part"])
    heads = bases.withColumn("depth", F.col("start") + F.col("rank")).where(F.col("depth") < HEAD).groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("depth", "md", "chars"))).alias("head"))      # fewer than HEAD
    convs = pieces.groupBy("conv").agg(F.sum("n").alias("turns")).withColumn("h", h)
    convs = convs.withColumn("base", block).join(
        heads.select(F.col("conv").alias("base"), "head"), "base", "left").withColumn(
        "head", F.when(F.col("conv") == F.col("base"), None).otherwise(F.slice("head", F.lit(1), F.col("h").cast("int"))))
    nothing = F.array().cast("array<struct<depth:bigint,md:string,chars:bigint>>")
    convs = saved(convs.select(
        "conv", F.when(F.col("conv") == F.col("base"), 0).otherwise(F.col("h")).alias("skip"),
        F.coalesce("head", nothing).alias("head"), "turns").withColumn(
        "length", F.size("head") + F.greatest(F.lit(0), F.col("turns") - F.col("skip"))), "convs")

    # borrowed turns: fewer than HEAD a conversation, and the root
    upto = Window.partitionBy("conv").orderBy("depth")
    taken = convs.select("conv", "length", F.explode("head").alias("t")).select(
        "conv", "length", F.col("t.depth").alias("depth"), F.col("t.chars").alias("chars"),
        F.col("t.md").alias("md"))
    taken = taken.select("*", *[x.alias(s) for s, x in zip(SUMS, numbers(F.col("depth"), F.col("md")))])
    taken = taken.select("conv", "length", "depth", "chars", *[c for s in SUMS for c in (
        F.sum(s).over(upto).alias(s), (F.sum(s).over(upto) - F.col(s)).alias("p" + s))])
    root = convs.select("conv", "length", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"),
                        *[F.lit(0).cast("long").alias(p + s) for s in SUMS for p in ("", "p")])

    # own turns after the first h: sums within a range, then over the ranges
    info = saved(pieces.join(convs, "conv").select(
        "conv", "part", "start", "skip", "length", (F.size("head") - F.col("skip")).cast("long").alias("shift"),
        *[_total("head", lambda t, k=k: numbers(t["depth"], t["md"])[k]).alias("b" + s) for k, s in enumerate(SUMS)]), "pieces")
    rows = own.join(info, ["conv", "part"]).withColumn("at", F.col("start") + F.col("rank")).where("at > skip")
    rows = rows.withColumn("depth", F.col("at") + F.col("shift"))
    rows = rows.select("conv", "part", "length", "depth", "chars", *["b" + s for s in SUMS],
                       *[x.alias(s) for s, x in zip(SUMS, numbers(F.col("depth"), F.col("md")))])
    inside = Window.partitionBy("conv", "part").orderBy("depth")
    rows = saved(rows.select("conv", "part", "length", "depth", "chars", *[c for s in SUMS for c in (
        (F.col("b" + s) + F.sum(s).over(inside)).alias(s), F.col(s).alias("o" + s))]), "summed")
    whole = rows.groupBy("conv", "part").agg(*[F.sum("o" + s).alias("t" + s) for s in SUMS])
    whole = whole.select("conv", "part", *[
        F.coalesce(F.sum("t" + s).over(_before("conv")), F.lit(0).cast("long")).alias("t" + s) for s in SUMS])
    rows = rows.join(whole, ["conv", "part"]).select("conv", "length", "depth", "chars", *[c for s in SUMS for c in (
        (F.col(s) + F.col("t" + s)).alias(s), (F.col(s) + F.col("t" + s) - F.col("o" + s)).alias("p" + s))])

    path = rows.unionByName(taken).unionByName(root)
    return saved(path.select(
        "conv", "depth", node_name(F.col("depth"), [F.col(s) for s in SUMS]).alias("node"),
        F.when(F.col("depth") > 0, node_name(F.col("depth") - 1, [F.col("p" + s) for s in SUMS])).alias("parent"),
        "chars", (F.col("depth") == F.col("length")).alias("last")), "paths")


def roll_up(paths: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """node and the sums of ``values`` over its subtree (nodes whose sums are
    all 0 may be left out). ``paths``: conv, at (the depth, gapless from 0 in
    each conv), node, and ``values``, which are null but in the one row that
    stands for the node."""
    zero = F.lit(0).cast("long")
    some = F.lit(False)
    for v in values:
        some = some | (F.col(v) != 0)
    band = F.floor(F.col("at") / BAND)

    def added(rows: DataFrame) -> DataFrame:
        return rows.where(some).groupBy("node").agg(*[F.sum(v).alias(v) for v in values])

    # up to BAND nodes of one path, with what the path holds at and below each
    short = paths.select("conv", band.alias("band"), "at", "node", *[F.coalesce(v, zero).alias(v) for v in values]).groupBy(
        "conv", "band").agg(F.array_sort(F.collect_list(F.struct("at", "node", *values))).alias("w"))
    below = F.slice(F.col("w"), F.col("k") + 1, F.size("w"))
    partial = added(short.select("w", F.posexplode("w").alias("k", "x")).select(F.col("x.node").alias("node"), *[
        _total(below, lambda y, v=v: y[v]).alias(v) for v in values]))
    if deepest < BAND:
        return partial
    partial = saved(partial, "band-totals")
    # the bands' roots: a trie of its own, BAND times less deep
    roots = paths.where(F.col("at") % BAND == 0).select("conv", band.alias("at"), "node", F.col(values[0]).isNotNull().alias("own"))
    owned = saved(roots.where("own").drop("own").join(partial, "node", "left").select(
        "conv", "at", "node", *[F.coalesce(v, zero).alias(v) for v in values]), "band-roots")
    upper = roots.select("conv", "at", "node").join(owned.drop("at"), ["conv", "node"], "left")
    complete = roll_up(saved(upper, "upper"), values, deepest // BAND)
    # a root's completed total goes to the nodes of the band above it, on its path
    handed = owned.where("at > 0").select("conv", (F.col("at") - 1).alias("band"), "node").join(complete, "node").drop("node")
    nodes = paths.select("conv", band.alias("band"), "node")
    return partial.unionByName(added(handed.join(nodes, ["conv", "band"]).select("node", *values))).groupBy("node").agg(
        *[F.sum(v).alias(v) for v in values])


def ends(paths: DataFrame) -> DataFrame:
    """node, ends_sha256 of the ids that end there, ascending, comma-joined."""
    last = paths.where("last").select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")

    def joined(batches):
        node, ids = None, []
        for b in batches:
            for x, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (x != node or len(ids) == PIECE):
                    yield pa.RecordBatch.from_pydict({"node": [node], "first": [ids[0]], "ids": [",".join(map(str, ids))]})
                    ids = []
                node = x
                ids.append(c)
        if ids:
            yield pa.RecordBatch.from_pydict({"node": [node], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

    def digests(batches):
        node, state = None, None
        for b in batches:
            out = []
            for x, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if x != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = x, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)],
                                             names=["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]})

    pieces = saved(last.mapInArrow(joined, "node string, first long, ids string"), "ends")
    return pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(
        digests, "node string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = rebuilt(conversations, **columns)
    # depth, parent and chars are the same in all rows of a node
    nodes = saved(paths.groupBy("node", "depth", "parent", "chars").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs")), "nodes")
    seen = nodes.agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).first()
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    family = saved(nodes.join(children, "node", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "family")
    valued = family.select("conv", "node", (F.col("n_children") == 0).cast("long").alias("n_leaves"), (
        (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    # a node's values stand in the row of its smallest member alone
    steps = paths.select("conv", F.col("depth").alias("at"), "node").join(valued, ["conv", "node"], "left")
    totals = roll_up(saved(steps, "steps"), ["n_leaves", "saved_tokens"], int(seen["deepest"] or 0))
    parents = saved(family.where("n_children > 0").select(
        F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("uses")), "parents")
    named = lookup(family, "parent", parents, "uses", int(seen["n"]))
    zero = F.lit(0).cast("long")
    return named.join(totals, "node", "left").join(ends(paths), "node", "left").select(
        F.col("conv").cast("long").alias("conv_id"), "depth", F.col("parent_conv_id").cast("long").alias("parent_conv_id"),
        "n_convs", "n_children", F.coalesce("n_leaves", zero).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
