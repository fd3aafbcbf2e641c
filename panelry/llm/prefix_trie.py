"""The trie of conversation prefixes and its subtree totals by parallel tree contraction.

A conversation's first d turns are a node of depth d, under the root of depth 0. Nodes are found by one hash per (position,
role, text): a prefix is the XOR of its turns' hashes, so that a node's parent is known from the node itself, and a long
conversation's prefixes are put together from blocks.

Subtree totals take alternate steps of two kinds, together in one round of joins. Rake: every leaf hands its total to its
parent and goes. Compress: of a chain of nodes with one child each, a random independent part goes; such a node hands what
it has gathered to its parent, and its child moves up to that parent. Each round takes all leaves and a constant share of
every chain, so the number of rounds is logarithmic, whatever the depth. Then the contracted nodes are expanded again: a
raked node had its whole total when it went, a compressed one is completed by the total of the child it had. All joins are on keys
that are unique on both sides; parents with many children only ever take sums, combined before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, gapless, give_back, stored

#: Turns of a conversation whose hashes are added up by one task.
BLOCK = 4096
#: Bytes of joined ids that travel as one row.
CHUNK_BYTES = 1 << 20
#: Rounds after which a contraction is given up as broken; each takes a constant share of the nodes.
ROUNDS = 400


def turns_in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, chars): turns numbered from 0 in their conversation, with two hashes of role and text.

    The order is by turn, null first; equal turns by role, then by the text's beginning and hash. Null role or text counts
    as empty; rows without conv_id belong to no conversation and go. Repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"), F.length(text).cast("long").alias("chars"),
    )
    return gapless(rows, ["conv_id"], ["turn", "role", "head", "t1"], "pos").select("conv_id", "pos", "t1", "t2", "chars")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, chars) of every prefix of one turn or more; k is the node, p its parent.

    turns: (conv_id, pos, t1, t2, chars) with pos gapless from 0. No task holds a conversation: blocks of turns are summed
    first, then blocks.
    """
    at = turns.withColumn("h1", F.xxhash64("pos", "t1")).withColumn("h2", F.xxhash64("pos", "t2")).withColumn("block", F.floor(F.col("pos") / BLOCK))
    inside = W.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    at = at.select("conv_id", "pos", "block", "h1", "h2", "chars", *[F.bit_xor(h).over(inside).alias(k) for h, k in (("h1", "k1"), ("h2", "k2"))])
    out = at.where("block = 0").drop("block")
    later = turns.where(F.col("pos") >= BLOCK).select("conv_id").limit(1)
    if not later.isEmpty():
        sums = at.groupBy("conv_id", "block").agg(*[F.bit_xor(h).alias(h) for h in ("h1", "h2")])
        before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *[F.bit_xor(h).over(before).alias(f"b{h}") for h in ("h1", "h2")])
        more = at.where("block > 0").join(sums, (F.col("conv_id") == F.col("c")) & (F.col("block") == F.col("b")))
        more = more.withColumn("k1", F.col("k1").bitwiseXOR(F.col("bh1"))).withColumn("k2", F.col("k2").bitwiseXOR(F.col("bh2")))
        out = out.unionByName(more.select(*out.columns))
    return out.select("conv_id", (F.col("pos") + 1).alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "chars")


def _key(a: str, b: str, depth: Column | str) -> Column:
    """A node's id: its depth and 128 bits of its sequence."""
    return F.struct(F.col(depth).alias("d") if isinstance(depth, str) else depth.alias("d"), F.col(a).alias("a"), F.col(b).alias("b"))


def contract(tree: DataFrame, values: list[str], kids: str = "n_children") -> DataFrame:
    """(id, values...): the sum of each value over each node's subtree, the node included.

    tree: (id, parent, kids, values...); id of any type, unique; parent is null at the roots; kids is the number of
    children, null for none. Any shape is right: forests, single nodes, chains of any length, no node at all.
    """
    live = stored(tree.select("id", "parent", F.coalesce(kids, F.lit(0)).cast("long").alias("n"), *values))
    raked, spliced, spent = [], [], [live]
    for k in range(ROUNDS):
        if live.isEmpty():
            break
        leaf = F.col("n") == 0
        picked = (F.col("n") == 1) & F.col("parent").isNotNull() & (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2)) == 0)
        only = live.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.min(F.struct("id", (~leaf & ~picked).alias("stays"))).alias("c"))
        state = live.join(only, F.col("id") == F.col("of"), "left")
        state = stored(state.select("id", "parent", "n", *values, leaf.alias("leaf"), (picked & F.coalesce("c.stays", F.lit(False))).alias("spliced"), F.col("c.id").alias("child")))
        gone = state.where("(leaf or spliced) and parent is not null")
        up = gone.groupBy(F.col("parent").alias("of")).agg(F.count_if("leaf").alias("_n"), *[F.sum(v).alias(f"_{v}") for v in values])
        moved = state.where("spliced").select(F.col("child").alias("to"), F.col("parent").alias("above"))
        rest = state.where("not leaf and not spliced").join(up, F.col("id") == F.col("of"), "left").join(moved, F.col("id") == F.col("to"), "left")
        live = stored(rest.select("id", F.coalesce("above", "parent").alias("parent"), (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]))
        raked.append(state.where("leaf").select("id", *values))
        spliced.append(state.where("spliced").select("id", F.col("child").alias("to"), *values))
        spent += [state, live]
    else:
        raise RuntimeError("the contraction did not settle")
    if not raked:
        return live.select("id", *values)
    totals, open_ = raked[0], spliced[0]
    for a, b in zip(raked[1:], spliced[1:], strict=True):
        totals, open_ = totals.union(a), open_.union(b)
    # Each spliced node waits for the child it was spliced onto, which went in a later round: paths of at most so many
    # steps, all halved at once.
    open_ = stored(open_)
    spent.append(open_)
    for _ in range((len(raked) - 1).bit_length()):
        on = open_.select(F.col("id").alias("of"), F.col("to").alias("next"), *[F.col(v).alias(f"_{v}") for v in values])
        open_ = stored(open_.join(on, F.col("to") == F.col("of"), "left").select("id", F.coalesce("next", "to").alias("to"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]))
        spent.append(open_)
    below = totals.select(F.col("id").alias("of"), *[F.col(v).alias(f"_{v}") for v in values])
    filled = open_.join(below, F.col("to") == F.col("of")).select("id", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])
    out = stored(totals.union(filled))
    discard(*spent)
    return out


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie: id, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    turns: (conv_id, pos, t1, t2, chars), pos gapless from 0 in each conversation; convs: distinct conv_id, also those
    without turns, which are members of the root alone. No conversation gives no node, not even a root.
    """
    nowhere = F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    rows = stored(prefixes(turns))
    parent = _key("p1", "p2", F.col("depth") - 1)
    nodes = rows.groupBy(_key("k1", "k2", "depth").alias("id"), parent.alias("parent")).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"))
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(nowhere.alias("id"), F.lit(None).cast("struct<d: long, a: long, b: long>").alias("parent"), "n_convs", "conv_id", F.lit(0).cast("long").alias("chars"))
    nodes = stored(nodes.unionByName(root))
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, F.col("id") == F.col("of"), "left").drop("of")
    own = F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
    nodes = stored(nodes.select("*", *own))
    totals = contract(nodes, ["n_leaves", "saved_tokens"])
    last = rows.groupBy("conv_id").agg(F.max(_key("k1", "k2", "depth")).alias("last")).select(F.col("conv_id").alias("c"), "last")
    ends = ends_hashes(convs.join(last, F.col("conv_id") == F.col("c"), "left").select(F.coalesce("last", nowhere).alias("id"), "conv_id"))
    # A parent's smallest member: the root's comes as one row, so that its many children meet in no task.
    top = F.broadcast(nodes.where("parent is null").select(F.col("conv_id").alias("top")))
    above = nodes.where("n_children is not null and parent is not null").select(F.col("id").alias("of"), F.col("conv_id").alias("above"))
    first = nodes.where("id.d <= 1").crossJoin(top).withColumn("above", F.when(F.col("id.d") == 1, F.col("top"))).drop("top")
    deep = nodes.where("id.d > 1").join(above, F.col("parent") == F.col("of")).drop("of")
    out = first.unionByName(deep).drop("n_leaves", "saved_tokens")
    out = out.join(totals.select(F.col("id").alias("of"), "n_leaves", "saved_tokens"), F.col("id") == F.col("of")).drop("of")
    out = out.join(ends.select(F.col("id").alias("of"), "ends_sha256"), F.col("id") == F.col("of"), "left")
    return out.select(
        "id", "conv_id", F.col("id.d").alias("depth"), F.col("above").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """prefix_trie() of a table (conv_id, turn, role, text). Rows without conv_id are in no conversation."""
    turns = stored(turns_in_order(conversations))
    return prefix_trie(turns, stored(turns.select("conv_id").distinct()))


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) from (id, conv_id): SHA-256 of each node's conv_ids, ascending, comma-joined.

    Ids are sorted over ranges of (id, conv_id) and joined to chunks of CHUNK_BYTES where they lie, so that a node of any
    size is spread over tasks; its few chunks then stream in order through one hash.
    """
    key = ["d", "a", "b"]
    flat = ends.select(*[F.col(f"id.{x}").alias(x) for x in key], "conv_id")
    sorted_ = flat.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        node, first, size = None, None, 0
        rows: list[tuple] = []

        def close() -> None:
            if held:
                rows.append((*node, first, ",".join(held).encode()))

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            batch = pa.RecordBatch.from_arrays([pa.array(cols[i], pa.int64()) for i in range(4)] + [pa.array(cols[4], pa.binary())], [*key, "first", "ids"])
            rows.clear()
            return batch

        for batch in batches:
            d, a, b, convs = (c.to_pylist() for c in batch.columns)
            for i, conv in enumerate(convs):
                at = (d[i], a[i], b[i])
                if at != node or size > CHUNK_BYTES:
                    close()
                    node, first, held, size = at, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            if sum(len(r[4]) for r in rows) > 4 * CHUNK_BYTES or len(rows) > 10_000:
                yield out()
        close()
        yield out()
        give_back()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        rows: list[tuple] = []
        for batch in batches:
            d, a, b, raw = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            for i, ids in enumerate(raw):
                at = (d[i], a[i], b[i])
                if at == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        rows.append((*node, sha.hexdigest()))
                    node, sha = at, hashlib.sha256()
                sha.update(ids)
        if node is not None:
            rows.append((*node, sha.hexdigest()))
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[i], pa.int64()) for i in range(3)] + [pa.array(cols[3], pa.string())], [*key, "ends_sha256"])

    joined = stored(sorted_.mapInArrow(chunks, "d long, a long, b long, first long, ids binary"))
    each = joined.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, "d long, a long, b long, ends_sha256 string")
    return each.select(F.struct(*key).alias("id"), "ends_sha256")
