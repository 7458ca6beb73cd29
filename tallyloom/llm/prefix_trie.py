"""Prefix trie of conversations by van Emde Boas recursion.

Depths are cut in halves, as long as a block of depths has more than one. A block's problem
is a set of sequences below a common prefix, its group. Sequences that agree up
to the half are named after the smallest conversation that has this cut prefix; the upper
trie takes each cut prefix once, and what is left of the sequences goes to lower forests, one
for each name. All problems of a level are solved at once, in one Spark job, and there are
as many levels as the greatest depth has binary digits. A node is known by its depth
and its smallest member, so names need no numbering. Contents of halves are compared by 128-bit
digests, made from the bottom up.

Totals go upward the same way: when tries of height 2^j have theirs, those that hang 2^j levels
below a node are grafted on it, which gives totals of height 2^(j+1).

A conversation may hold most rows: rows are numbered over ranges, not in one task for each conversation, and
its halves are hashed block by block. A prefix may be shared by most conversations:
its members are summed before they are shuffled, and only one sequence of it goes on upward. Digests
of members read their numbers in order, piece by piece, in constant memory; that one
hash runs over all members of a node in sequence is in its definition.

Defined cases: rows without conv_id take no part. Null roles and texts are empty.
Turns are ordered by turn (null first), then role and text as bytes, so ties and
repeated rows have one order. An empty table has no node. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.prefix import numbered
from tallyloom.scratch import materialize

#: A rebuilt conversation takes less than PRE turns from the first of GROUP neighbours.
PRE, GROUP = 9, 5
#: Members of a node are handed on in pieces of so many.
PIECE = 4096


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, sym, n_bytes): turns numbered from 0 in each conversation; sym is a digest of role and text."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = numbered(turns, order, F.lit(0)).select(
        "conv", "number", F.octet_length("text").cast("long").alias("n_bytes"),
        F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("sym"),
    )
    placed = materialize(placed, "turns")
    first = placed.groupBy("conv").agg(F.min("number").alias("first"))
    return placed.join(first, "conv").select("conv", (F.col("number") - F.col("first")).alias("pos"), "sym", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and (conv, len) of each of them.

    Conversation c takes the first h turns of conversation c - c % GROUP, h being the CRC-32 of c in
    decimal modulo PRE, and then its own turns but its first h.
    """
    turns = materialize(turns, "ordered")
    own = turns.groupBy("conv").agg(F.count("*").alias("n"))
    base = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    own = own.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % PRE).withColumn("base", F.col("conv") - F.col("conv") % GROUP)
    own = materialize(own.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "rebuilt")
    heads = turns.where(F.col("pos") < PRE).withColumnRenamed("conv", "base")
    heads = heads.join(own.select("conv", "base", "taken"), "base").where("pos < taken").select("conv", "pos", "sym", "n_bytes")
    rest = turns.join(own.select("conv", "h", "taken"), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "sym", "n_bytes")
    length = own.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    return heads.union(rest), length


def _halves(turns: DataFrame, levels: int) -> list[DataFrame]:
    """For each level k, (conv, block, seg): digests of the full blocks of 2^k turns."""
    found = [turns.select("conv", F.col("pos").alias("block"), F.col("sym").alias("seg"))]
    for _ in range(1, levels):
        side = lambda bit: F.max(F.when(F.col("block") % 2 == bit, F.col("seg")))
        pair = found[-1].groupBy("conv", F.expr("block div 2").alias("block")).agg(side(0).alias("left"), side(1).alias("right"))
        pair = pair.where("right IS NOT NULL").select("conv", "block", F.unhex(F.md5(F.concat("left", "right"))).alias("seg"))
        found.append(materialize(pair, "halves"))
    return found


def prefix_nodes(turns: DataFrame, length: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes below the root (depth, conv, parent, n_convs, n_bytes), and where conversations end (depth, node, conv).

    `turns` has (conv, pos, sym, n_bytes) with all positions from 0, `length` has (conv, len). conv of a node is its smallest member.
    """
    turns = materialize(turns, "turns")
    whole = length.agg(F.max("len").alias("most"), F.min("conv").alias("root")).first()
    longest, root = whole["most"] or 0, F.lit(whole["root"]).cast("long")
    levels = max(1, (longest - 1).bit_length() + 1) if longest else 0
    ends = [length.where("len = 0").select(F.lit(0).cast("long").alias("depth"), root.alias("node"), "conv")]
    if not longest:
        return turns.select(F.lit(0).cast("long").alias("depth"), "conv", F.col("conv").alias("parent"), F.col("pos").alias("n_convs"), "n_bytes").limit(0), ends[0]
    halves = _halves(turns, levels)
    # A row is a sequence of a problem: its group, the conversation it is read from, its block of depths, how many
    # conversations it stands for, where it stops, and whether its conversation ends there.
    rows = length.where("len > 0").select(
        root.alias("g"), "conv", F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("n"), "len", F.lit(True).alias("real")
    )
    for k in range(levels - 1, 0, -1):
        half = 1 << (k - 1)
        cut = (F.col("block") * 2 + 1) * half
        seg = halves[k - 1].select("conv", F.col("block").alias("at"), "seg")
        rows = materialize(rows.withColumn("at", F.col("block") * 2).join(seg, ["conv", "at"], "left").withColumn("cut", cut), "rows")
        whole = rows.where("seg IS NOT NULL")
        names = whole.groupBy("g", "block", "seg").agg(F.min("conv").alias("u"), F.sum("n").alias("n_all"), F.first("cut").alias("cut"))
        names = materialize(names, "names")
        upper = names.select("g", F.col("u").alias("conv"), (F.col("block") * 2).alias("block"), F.col("n_all").alias("n"), F.col("cut").alias("len"), F.lit(False).alias("real"))
        short = rows.where("seg IS NULL").select("g", "conv", (F.col("block") * 2).alias("block"), "n", "len", "real")
        named = materialize(whole.join(names.select("g", "block", "seg", "u"), ["g", "block", "seg"]), "named")
        lower = named.where("len > cut").select(F.col("u").alias("g"), "conv", (F.col("block") * 2 + 1).alias("block"), "n", "len", "real")
        ends.append(named.where("len = cut AND real").select(F.col("cut").alias("depth"), F.col("u").alias("node"), "conv"))
        rows = upper.union(short).union(lower)
    rows = materialize(rows.join(turns.withColumnRenamed("pos", "block"), ["conv", "block"]), "rows")
    nodes = rows.groupBy("g", "block", "sym").agg(F.min("conv").alias("u"), F.sum("n").alias("n_convs"), F.first("n_bytes").alias("n_bytes"))
    nodes = materialize(nodes, "nodes")
    last = rows.where("real AND len = block + 1").select("g", "block", "sym", "conv").join(nodes.select("g", "block", "sym", "u"), ["g", "block", "sym"])
    ends.append(last.select((F.col("block") + 1).alias("depth"), F.col("u").alias("node"), "conv"))
    found = ends[0]
    for more in ends[1:]:
        found = found.union(more)
    return nodes.select((F.col("block") + 1).alias("depth"), F.col("u").alias("conv"), F.col("g").alias("parent"), "n_convs", "n_bytes"), found


def graft(nodes: DataFrame, *values: str) -> DataFrame:
    """`nodes` (depth, conv, parent, ...) with each value summed over the node's subtree."""
    found = materialize(nodes.withColumn("up", F.col("parent")), "totals")
    deepest, j = found.agg(F.max("depth").alias("most")).first()["most"] or 0, 0
    while 1 << j <= deepest:
        # Nodes of at least this depth have a node 2^j above them, `up`.
        hung = found.where(F.col("depth") >= 1 << j).groupBy((F.col("depth") - (1 << j)).alias("depth"), F.col("up").alias("conv"))
        hung = hung.agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        jump = found.select((F.col("depth") + (1 << j)).alias("depth"), F.col("conv").alias("up"), F.col("up").alias("up_up"))
        step = found.join(jump, ["depth", "up"], "left").join(hung, ["depth", "conv"], "left")
        summed = {v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0)) for v in values}
        found = materialize(step.withColumns(summed | {"up": F.col("up_up")}).select(*found.columns), "totals")
        j += 1
    return found.drop("up")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of members of one node, comma-joined, at most PIECE in a row."""
    for batch in batches:
        depth, node, conv = (batch.column(i).to_pylist() for i in range(3))
        rows, first = [], 0
        for i in range(1, len(conv) + 1):
            if i == len(conv) or (depth[i], node[i]) != (depth[first], node[first]) or i - first == PIECE:
                rows.append((depth[first], node[first], conv[first], ",".join(map(str, conv[first:i]))))
                first = i
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], ["depth", "node", "first", "members"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, state = None, None
    kind = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        rows = []
        for depth, node, members in zip(*(batch.column(n).to_pylist() for n in ("depth", "node", "members"))):
            if (depth, node) != at:
                if at:
                    rows.append((*at, state.hexdigest()))
                at, state = (depth, node), hashlib.sha256(members.encode())
            else:
                state.update(b"," + members.encode())
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], kind)
    if at:
        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, (*at, state.hexdigest())))], kind)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of nodes where conversations end."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = ends.repartitionByRange(parts, "depth", "node", "conv").sortWithinPartitions("depth", "node", "conv")
    pieces = laid.select("depth", "node", "conv").mapInArrow(_pieces, "depth long, node long, first long, members string")
    pieces = materialize(pieces, "members")
    return pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_digests, "depth long, node long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row for each prefix node of the rebuilt conversations; see the columns at the end."""
    turns, length = rebuilt(ordered_turns(conversations))
    length = materialize(length, "lengths")
    nodes, ends = prefix_nodes(turns, length)
    members: Column = F.count("*").alias("n_convs")
    none = F.lit(None).cast(T.LongType()).alias("parent")
    root = length.agg(F.min("conv").alias("conv"), members).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), "conv", none, "n_convs", F.lit(0).cast("long").alias("n_bytes"))
    nodes = materialize(root.union(nodes), "trie")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "conv"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_bytes"))
    totals = graft(nodes, "n_leaves", "saved_tokens")
    digest = ends_digest(ends).withColumnRenamed("node", "conv")
    return totals.join(digest, ["depth", "conv"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
