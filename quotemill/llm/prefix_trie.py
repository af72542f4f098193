"""Prefix trie of conversations by vertical bitmaps.

A node of depth d is a distinct sequence of the first d turns (role and text), the root has no turns, and a
node's members are the conversations that start with it. Conversations are dealt into shards of
``SHARD`` neighbouring ids. Inside a shard every (position, turn) has a bitset of the conversations that hold
the turn there; depth first, a node's bitset intersected with the postings of the next position yields its
children, and population counts and the lists of conversations that end there go with them. Positions are
worked through in bands of ``BAND``, so a task holds at most SHARD x BAND turns, however long a
conversation is.

Nodes of shards meet by a 128-bit hash of their path: one row per shard and node, so a first turn that a third
of all conversations share is a row per shard. From there on a node is named (smallest member, depth).
The nodes of one smallest member form a chain down from where it left a smaller one's path; sums over
subtrees are running sums along chains plus the totals of the chains that leave them, and those totals come
from pointer doubling over the tree of chains, a round per doubling of its depth.

``rebuild`` gives conversations shared prefixes: the first turns of one conversation of each hundred.

Cases: NULL role or text is empty; turns are ordered by turn (NULL first), then role, then text, repeated rows
are turns; rows without conv_id are no conversation; conversations may have no turn left; an empty table
gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.common import looked_up, stored

#: Conversations of a shard (a power of two) and positions of a band.
SHARD, BAND = 1024, 64
#: One conversation of so many lends its first turns, up to so many of them.
CENTURY, MOST_SHARED = 100, 5
#: Chains that at least one in so many others leave are broadcast.
OFTEN = 1000

TURN = ["k1", "k2"]
LOCAL = "shard long, depth long, p1 long, p2 long, q1 long, q2 long, conv long, n long, chars long, ends string"


def turn_rows(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), k1, k2 (128 bits of role and text), chars: turns in order, without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                                                     role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return slim.select("conv_id", F.row_number().over(order).cast("long").alias("pos"),
                       F.xxhash64(F.lit(1), "role", "text").alias("k1"), F.xxhash64(F.lit(2), "role", "text").alias("k2"),
                       F.length("text").cast("long").alias("chars"))


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes over: a checksum of its decimal id, modulo six."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)


def rebuild(rows: DataFrame) -> DataFrame:
    """The rows of ``turn_rows`` (stored) with the first turns of the century's conversation instead of the own ones.

    Every conversation also has a row at position 0 (keys and chars 0), so that none gets lost.
    """
    lent = rows.where((F.col("conv_id") % CENTURY == 0) & (F.col("pos") <= MOST_SHARED)).select(
        F.col("conv_id").alias("base"), "pos", "k1", "k2", "chars")
    held = lent.groupBy("base").agg(F.count("*").alias("held"))
    base = F.col("conv_id") - F.col("conv_id") % CENTURY
    convs = (rows.select("conv_id").distinct().withColumn("base", base).withColumn("h", shared_turns(F.col("conv_id")))
             .join(held, "base", "left").withColumn("m", F.least("h", F.coalesce("held", F.lit(0)))))
    borrowed = convs.join(lent, "base").where("pos <= h").select("conv_id", "pos", "k1", "k2", "chars")
    own = (rows.join(convs.select("conv_id", "h", "m"), "conv_id").where("pos > h")
           .select("conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("pos"), "k1", "k2", "chars"))
    zero = F.lit(0).cast("long")
    start = convs.select("conv_id", zero.alias("pos"), zero.alias("k1"), zero.alias("k2"), zero.alias("chars"))
    return start.unionByName(borrowed).unionByName(own)


def with_paths(rows: DataFrame) -> DataFrame:
    """Adds p1, p2 (the path up to a turn), q1, q2 (before it), last (no turn follows), shard and band."""
    order = Window.partitionBy("conv_id").orderBy("pos")
    out = rows.withColumn("last", F.lead("pos").over(order).isNull())
    for i in (1, 2):
        own = F.when(F.col("pos") > 0, F.xxhash64(F.lit(2 + i), "k1", "k2", "pos")).otherwise(F.lit(0).cast("long"))
        out = out.withColumn(f"o{i}", own).withColumn(
            f"p{i}", F.bit_xor(f"o{i}").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn(f"q{i}", F.col(f"p{i}").bitwiseXOR(F.col(f"o{i}"))).drop(f"o{i}")
    return (out.withColumn("shard", F.shiftright("conv_id", SHARD.bit_length() - 1))
            .withColumn("band", F.floor(F.col("pos") / BAND)))


def local_nodes(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard and band, depth first over bitsets of its conversations."""
    group = group.sort_values(["conv_id", "pos"], kind="stable")
    convs = sorted(set(group["conv_id"].tolist()))
    number = {c: i for i, c in enumerate(convs)}
    postings: dict[tuple, int] = defaultdict(int)
    alive: dict[int, int] = defaultdict(int)
    ending: dict[int, int] = defaultdict(int)
    said: dict[tuple[int, int], tuple] = {}
    roots: dict[tuple[int, int, int], int] = defaultdict(int)
    low = int(group["pos"].min())
    columns = [group[c].tolist() for c in ("conv_id", "pos", "k1", "k2", "chars", "p1", "p2", "q1", "q2", "last")]
    for conv, pos, k1, k2, chars, p1, p2, q1, q2, last in zip(*columns):
        i = number[conv]
        bit = 1 << i
        postings[pos, k1, k2] |= bit
        alive[pos] |= bit
        said[i, pos] = (k1, k2, chars, p1, p2)
        if last:
            ending[pos] |= bit
        if pos == low:  # paths that come into this band
            roots[q1, q2] |= bit
    out = []
    shard = int(group["shard"].iloc[0])
    stack = [(low - 1, bits, path) for path, bits in roots.items()]
    while stack:
        depth, bits, path = stack.pop()
        pos = depth + 1
        rest = bits & alive.get(pos, 0)
        while rest:
            first = (rest & -rest).bit_length() - 1
            k1, k2, chars, p1, p2 = said[first, pos]
            child = bits & postings[pos, k1, k2]
            rest &= ~child
            ends, end = [], child & ending.get(pos, 0)
            while end:
                one = end & -end
                ends.append(convs[one.bit_length() - 1])
                end ^= one
            out.append((shard, pos, p1, p2, *path, convs[first], child.bit_count(), chars,
                        ",".join(map(str, ends)) if ends else None))
            stack.append((pos, child, (p1, p2)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in LOCAL.split(", ")])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its shards' lists, which stream through in order."""
    now, digest, out = None, None, []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                           pa.array(columns[2], pa.string())], names=["conv_id", "depth", "ends_sha256"])

    for rows in batches:
        for node, ends in zip(zip(rows.column("conv_id").to_pylist(), rows.column("depth").to_pylist()), rows.column("ends")):
            if node != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(ends.as_py().encode())
            else:
                digest.update(b"," + ends.as_py().encode())
        yield batch()
        out = []
    if now is not None:
        out.append((*now, digest.hexdigest()))
        yield batch()


def _totals(chains: DataFrame) -> DataFrame:
    """chain, v1, v2: sums over a chain and all that leave it, by pointer doubling over up (NULL: none)."""
    now = chains
    while not now.where("up IS NOT NULL").isEmpty():
        rows = now.where("up IS NOT NULL")
        many = rows.count()
        sums = rows.groupBy("up").agg(F.sum("v1").alias("a1"), F.sum("v2").alias("a2"), F.count("*").alias("rows"))
        sums = stored(sums.withColumnRenamed("up", "at"), "trie-sums")
        often = sums.where(F.col("rows") * OFTEN >= many).select(F.col("at").alias("up"))
        over = now.select(F.col("chain").alias("up"), F.col("up").alias("above"))
        moved = looked_up(rows, over, "up", often).select("chain", F.col("above").alias("up"))
        added = now.drop("up").join(sums.drop("rows"), F.col("chain") == F.col("at"), "left").select(
            "chain", *[(F.col(f"v{i}") + F.coalesce(f"a{i}", F.lit(0))).alias(f"v{i}") for i in (1, 2)])
        now = stored(added.join(moved, "chain", "left").select("chain", "up", "v1", "v2"), "trie-chains")
    return now.drop("up")


def trie(rows: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node.

    ``rows``: conv_id, pos, k1, k2, chars, with a row at position 0 for every conversation (see ``rebuild``).
    """
    path = ["p1", "p2"]
    local = with_paths(rows).groupBy("shard", "band").applyInPandas(local_nodes, LOCAL)
    least = F.min("conv").over(Window.partitionBy("depth", *path))
    local = stored(local.withColumn("conv_id", least), "trie-shards")
    above = local.select("shard", (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                         F.col("conv_id").alias("parent_conv_id"))
    nodes = (local.drop("ends").join(above, ["shard", "depth", "q1", "q2"], "left").groupBy("depth", *path)
             .agg(F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"),
                  F.sum("n").alias("n_convs"), F.max("chars").alias("chars")))
    nodes = stored(nodes.drop(*path), "trie-nodes")
    children = (nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
                .agg(F.count("*").alias("n_children")))
    ends = (local.where("ends IS NOT NULL").select("conv_id", "depth", "shard", "ends").repartition("conv_id", "depth")
            .sortWithinPartitions("conv_id", "depth", "shard").mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string"))
    none = hashlib.sha256(b"").hexdigest()
    whole = (nodes.join(children, ["conv_id", "depth"], "left").join(ends, ["conv_id", "depth"], "left")
             .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
             .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
             .withColumn("v1", (F.col("n_children") == 0).cast("long"))
             .withColumn("v2", (F.col("n_convs") - 1) * F.col("chars")))
    whole = stored(whole, "trie-whole")
    head = F.min_by(F.struct("parent_conv_id", (F.col("depth") - 1).alias("at")), "depth")
    chains = stored(whole.groupBy(F.col("conv_id").alias("chain")).agg(head.alias("h"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"))
                    .select("chain", F.col("h.parent_conv_id").alias("up"), F.col("h.at").alias("at"), "v1", "v2"), "trie-heads")
    left = (_totals(chains.drop("at")).join(chains.select("chain", "up", "at"), "chain").where("up IS NOT NULL")
            .groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth"))
            .agg(F.sum("v1").alias("t1"), F.sum("v2").alias("t2")))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = whole.join(left, ["conv_id", "depth"], "left")
    return summed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        *[F.sum(F.col(f"v{i}") + F.coalesce(f"t{i}", F.lit(0))).over(below).cast("long").alias(name)
          for i, name in ((1, "n_leaves"), (2, "saved_tokens"))], "ends_sha256")


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    rows = stored(turn_rows(turns), "trie-turns")
    return trie(stored(rebuild(rows), "trie-rebuilt"))
