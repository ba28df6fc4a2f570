"""A trie of conversation prefixes: what conversations share, turn by turn.

Each prefix of a conversation gets a chained cryptographic digest, so prefixes are equal where digests are, and a node
of the trie is a group of (depth, digest). Subtree sums come from exploding each node to its ancestors.

A conversation may hold any share of all turns, so nothing here gathers one. Turns are ranked through ranges of equal
size, and chains are cut into blocks of FAN turns: within a block the chain is an expression over an array, and blocks
are chained as turns are, FAN at a time, and so on. The digest of a prefix is that of its whole blocks (the gate),
its chain within the block, and its place. Ancestors are exploded the same way: a node goes to those within its block
of depths, at most FAN, and the sums of whole blocks go from gate to gate. So rows grow with the number of turns, not with
its square, however long a conversation is; where none has more than FAN turns, each node goes to all its ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.llm.common import discard, lookup, table

WORD = "[^\\x20\\x09-\\x0D]+"
#: Turns of a block, and blocks of a block of blocks.
FAN = 16
#: Conversations whose first turns are taken from the same one, and one more than the number of turns taken at most.
FAMILY, TAKEN = 20, 4
#: The node of no turns.
ROOT = bytes(32)
#: Bytes of a piece of a list that is hashed.
PIECE = 1 << 20


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, link (a digest of role and text) and words of each turn; a written table.

    conversations needs conv_id, turn, role and text; other columns are ignored. Null roles and texts are empty. Rows without a
    conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    link = _digest(F.octet_length(role).cast("string").cast("binary"), F.lit(b":"), role.cast("binary"), text.cast("binary"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), link.alias("link"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    return table(rows, "trie-turns")


def _ordered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place in ranges of all turns, and one row for each conversation and range that it reaches into.

    Turns are in order of turn (null first), then of link; which of two equal turns is first makes no difference.
    The second table tells how many turns the conversation has in ranges before, and in all.
    """
    spark = rows.sparkSession
    by = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("link").asc(), F.col("row").asc()]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by)
    ordered = table(ranged.select("conv_id", "link", "words", F.monotonically_increasing_id().alias("place")).withColumn("range", F.shiftright("place", 33)), "trie-ordered")
    cuts = ordered.groupBy("conv_id", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("conv_id")  # a row for each range at most
    before = F.coalesce(F.sum("n").over(every.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered, cuts.select("conv_id", "range", "first", before.alias("before"), F.sum("n").over(every).alias("total"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The turns of every rebuilt conversation (conv_id, depth from 1, link, words, length), (conv_id, length) of each, and the tables to delete after.

    With h = crc32(decimal conv_id) % TAKEN, a conversation c starts with the first h turns of conversation c - c % FAMILY (all
    if it has fewer, none if there is no such one) and goes on with its own after its first h.
    """
    ordered, cuts = _ordered(rows)
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN
    cuts = cuts.withColumn("family", family).withColumn("h", head)
    bases = cuts.where("before = 0 AND conv_id = family").select(F.col("conv_id").alias("family"), F.col("total").alias("base_total"))
    taken = F.least("h", F.coalesce("base_total", F.lit(0)))
    cuts = cuts.join(bases, "family", "left").withColumn("taken", taken)
    cuts = table(cuts.withColumn("length", F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))), "trie-cuts")
    ranked = ordered.join(cuts, ["conv_id", "range"]).withColumn("rank", F.col("place") - F.col("first") + F.col("before") + 1)
    own = ranked.where("rank > h").select("conv_id", (F.col("rank") - F.col("h") + F.col("taken")).alias("depth"), "link", "words", "length")
    heads = ranked.where(F.col("rank") < TAKEN).where("conv_id = family").groupBy("family").agg(F.array_sort(F.collect_list(F.struct("rank", "link", "words"))).alias("heads"))
    convs = cuts.where("before = 0")
    first = convs.where("taken > 0").join(heads, "family").select("conv_id", "length", F.explode(F.slice("heads", 1, F.col("taken").cast("int"))).alias("t"))
    first = first.select("conv_id", F.col("t.rank").alias("depth"), "t.link", "t.words", "length")
    return own.unionByName(first), convs.select("conv_id", "length"), [ordered, cuts]


def _blocks(rows: DataFrame, *carried: str) -> DataFrame:
    """Rows (conv_id, depth, link, ...) in blocks of FAN depths: conv_id, block, links, the carried columns as arrays, and within, the chain of the links."""
    block = F.expr(f"(depth - 1) div {FAN}")
    found = rows.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("depth", "link", *carried))).alias("t"))
    chain = F.aggregate("t.link", F.array().cast("array<binary>"), lambda acc, x: F.concat(acc, F.array(_digest(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(b"")), x))))
    return found.select("conv_id", "block", chain.alias("within"), *[F.col(f"t.{c}").alias(c) for c in carried])


def _chained(blocks: DataFrame, deepest: int, level: int = 0) -> list[DataFrame]:
    """For this level and those above, tables (conv_id, block, gate, nodes, ...): the digests of all prefixes that end in the block, and the one at its gate.

    At a level above, a turn is a whole block of the level below, so a node there is one of the level below at a depth that FAN divides.
    The last block of a conversation goes up even if it isn't whole; its node there is no prefix's, and nothing asks for it.
    """
    blocks = table(blocks, f"trie-blocks{level}")
    place = lambda i: F.encode(F.concat(F.lit(f"{level}:"), (F.col("block") * FAN + i + 1).cast("string")), "utf-8")
    if deepest <= FAN:
        nodes = F.transform("within", lambda w, i: _digest(F.lit(ROOT), w, place(i)))
        return [table(blocks.withColumn("gate", F.lit(ROOT)).withColumn("nodes", nodes).drop("within"), f"trie-prefixes{level}")]
    whole = F.size("within") == FAN
    rows = blocks.where((F.col("block") > 0) | whole).select("conv_id", (F.col("block") + 1).alias("depth"), F.element_at("within", -1).alias("link"))
    above = _chained(_blocks(rows), -(-deepest // FAN), level + 1)
    up = above[0].select("conv_id", F.col("block").alias("above"), F.posexplode(F.arrays_zip(F.concat(F.array("gate"), F.slice("nodes", 1, F.size("nodes") - 1)).alias("before"), F.col("nodes").alias("node"))).alias("i", "z"))
    up = up.select("conv_id", (F.col("above") * FAN + F.col("i")).alias("block"), F.col("z.before").alias("gate"), F.col("z.node").alias("last"))
    joined = blocks.join(up, ["conv_id", "block"], "left").withColumn("gate", F.coalesce("gate", F.lit(ROOT)))
    nodes = F.transform("within", lambda w, i: F.when(i == FAN - 1, F.col("last")).otherwise(_digest(F.col("gate"), w, place(i))))
    out = table(joined.withColumn("nodes", nodes).drop("within", "last"), f"trie-prefixes{level}")
    discard(blocks)
    return [out, *above]


def _subtrees(nodes: DataFrame, levels: list[DataFrame], sums: tuple[str, ...]) -> DataFrame:
    """node and the sums of each node's subtree, itself included. nodes: conv_id (a member), depth, node, and the columns to sum; the root is one of them."""
    block = F.expr(f"(depth - 1) div {FAN}")
    here = levels[0].select("conv_id", "block", "gate", "nodes")
    placed = nodes.where("depth > 0").withColumn("block", block)
    gates = placed.join(here.select("conv_id", "block", "gate"), ["conv_id", "block"]).groupBy(F.col("gate").alias("node")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    if len(levels) > 1:  # sums of the blocks right below each gate, summed over the trie of gates
        tree = gates.join(nodes.select("conv_id", "depth", "node"), "node")
        made = [table(tree.select("conv_id", F.expr(f"depth div {FAN}").alias("depth"), "node", *[F.col(f"_{c}").alias(c) for c in sums]), "trie-gates")]
        made.append(_subtrees(made[0], levels[1:], sums))
        below = made[1].select("node", *[F.col(c).alias(f"_{c}") for c in sums])
        nodes = table(nodes.join(below, "node", "left").select("conv_id", "depth", "node", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]), "trie-summed")
        made.append(nodes)
        placed = nodes.where("depth > 0").withColumn("block", block)
        root = nodes.where("depth = 0").select("node", *sums)
    else:
        made = []
        root = nodes.where("depth = 0").join(gates, "node", "left").select("node", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums])
    to = F.explode(F.slice("nodes", 1, (F.col("depth") - F.col("block") * FAN).cast("int")))
    inner = placed.drop("node").join(here, ["conv_id", "block"]).select(to.alias("node"), *sums).groupBy("node").agg(*[F.sum(c).alias(c) for c in sums])
    out = table(inner.unionByName(root), "trie-sums")
    discard(*made)
    return out


PIECES = "node binary, first long, piece binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (node, conv_id) to comma-joined pieces of a node's ids, each with its first id."""
    node, ids, size = None, [], 0
    out: list[tuple] = []

    def batch():
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["node", "first", "piece"])

    for rows in batches:
        for n, c in zip(rows["node"].to_pylist(), rows["conv_id"].to_pylist(), strict=True):
            if n != node or size > PIECE:
                if ids:
                    out.append((node, int(ids[0]), ",".join(ids).encode()))
                    if len(out) == 10_000 or size > PIECE:
                        yield batch()
                node, ids, size = n, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        out.append((node, int(ids[0]), ",".join(ids).encode()))
        yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one SHA-256 for each node; a list is never held, only the state of its hash."""
    node, state = None, None
    for rows in batches:
        done: list[tuple] = []
        for n, piece in zip(rows["node"].to_pylist(), rows["piece"].to_pylist(), strict=True):
            if n != node:
                if state:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(piece)
            else:
                state.update(b"," + piece)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])


def list_digests(ends: DataFrame) -> DataFrame:
    """node and ends_sha256, the SHA-256 of its conv_ids in ascending order, joined by commas; rows of ends are (node, conv_id).

    A node's ids may be any share of all: they are sorted in ranges and made into pieces there; only pieces, of about PIECE bytes, meet.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, PIECES)
    return pieces.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a different sequence of the first turns (role and text) of rebuilt conversations; see `turns` and `rebuilt`, also
    for nulls and other columns. The root (depth 0) has every conversation, those without turns too. n_leaves and saved_tokens
    (words of a node's last text, times its members but one) are of the whole subtree; ends_sha256 is of the ids of
    conversations that end at the node. Rows that repeat are turns of their own, in any order as they are equal; turns with equal
    numbers are ordered by the digest of role and text; a table without conversations has no nodes.
    """
    rows = turns(conversations)
    every, convs, made = rebuilt(rows)
    deepest = convs.agg(F.max("length")).first()[0] or 0
    levels = _chained(_blocks(every, "words", "length"), deepest)
    each = levels[0].select("conv_id", "block", "gate", "nodes", F.posexplode(F.arrays_zip("nodes", "words", "length")).alias("i", "t"))
    depth = (F.col("block") * FAN + F.col("i") + 1).cast("long")
    parent = F.when(F.col("i") == 0, F.col("gate")).otherwise(F.get("nodes", F.col("i") - 1))
    each = each.select("conv_id", depth.alias("depth"), F.col("t.nodes").alias("node"), parent.alias("parent"), F.col("t.words").alias("words"), F.col("t.length").alias("length"))
    none = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), "length")
    each = each.unionByName(none)
    grouped = each.groupBy("depth", "node").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("parent").alias("parent"), F.first("words").alias("words"))
    grouped = table(grouped, "trie-grouped")
    children = grouped.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    own = grouped.join(children, "node", "left").select("conv_id", "depth", "node", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "words")
    own = table(own, "trie-nodes")
    leaf = (F.col("n_children") == 0).cast("long")
    values = own.select("conv_id", "depth", "node", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = _subtrees(values, levels, ("n_leaves", "saved_tokens"))
    ends = table(list_digests(each.where("depth = length").select("node", "conv_id")), "trie-ends")
    parents = own.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    out = lookup(own, parents, "parent", F.xxhash64("node"))
    out = out.join(sums, "node").join(ends, "node", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    discard(rows, *made, *levels, grouped)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
