"""The prefix trie of conversations, screened by a count-min sketch of prefix digests.

A prefix is the sequence of a conversation's first turns (role and text); its digest is chained from turn to turn. What
most conversations share is at most their first turns, so:

1. turns meet by conversation as digests and lengths, without their texts, and stream past in order; each gives a row per prefix;
2. a count-min sketch over all prefix digests (`countmin`) proves by an estimate of one that a prefix is no other
   conversation's. Such prefixes, nearly all tails, are nodes as they stand and are emitted where they lie;
3. only the others are grouped by digest, exactly. A false alarm of the sketch is a group of one.

What a node says of its subtree is a sum over its members: every node is owned by its smallest member, and a member
owns the nodes of its conversation from some depth on. So each member adds to each of its shared prefixes one child if
it owns the node below, one leaf if it owns the last node, and the lengths of the turns from there to the first node that it
owns, which are those that an earlier member has paid for. All these are plain sums, combined before the shuffle, whatever a
group's size. The sorted ids of conversations that end in a node are laid into ranges, joined in chunks there, and the chunks
stream through the hash.

Defined cases: turns of one conversation with the same number follow each other in the order of their digests (repeated rows
are turns of their own); a null turn number comes first; a null role or text is empty; rows without a conversation id
take no part; an empty table has no node, not even the root; extra columns are ignored. A conversation of very many
turns streams through one task in bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import countmin
from tidemark.llm.hot_join import join_hot
from tidemark.llm.shared import cut

SIZE = 16
#: The digest of the prefix without turns.
ROOT = bytes(SIZE)
#: Rows of a batch that a task emits, and ids that are joined at once.
ROWS, CHUNK = 20_000, 4096

PREFIX = "conv long, depth long, parent binary, digest binary, size long, last boolean"


def prefixes(conversations: DataFrame, base: Column | None = None, head: Column | None = None, most_head: int = 5, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, depth (from 0), parent and digest (16 bytes), size (code points of the last text), last, per conversation and prefix.

    base, head (of a conversation's id): instead of its first `head` turns, which are at most most_head, a conversation has
    those of conversation `base`: fewer, if base has fewer, and none, if there is no such conversation.
    """
    conv = F.col(conv_col).cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    leaf = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)), 1, SIZE)
    rows = conversations.where(conv.isNotNull()).select(
        (conv if base is None else base.cast("long")).alias("base"), conv.alias("conv"), (F.lit(0) if head is None else F.least(head, F.lit(most_head))).cast("int").alias("head"),
        F.col(turn_col).alias("turn"), leaf.alias("leaf"), F.length(text).cast("long").alias("size"),
    )
    order = ("base", F.col("conv") != F.col("base"), "conv", "turn", "leaf")
    ordered = rows.repartition("base").sortWithinPartitions(*order).drop("turn")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        at_base = at_conv = held = None
        heads: list[tuple[bytes, int]] = []
        turn = 0

        def out() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv", "depth", "parent", "digest", "size", "last"])
            done.clear()
            return made

        def grown(leaf: bytes, size: int) -> tuple:
            conv, depth, _, parent, _ = held
            done.append((*held, False))
            return conv, depth + 1, parent, hashlib.blake2b(parent + leaf, digest_size=SIZE).digest(), size

        for batch in batches:
            for base, conv, head, leaf, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if base != at_base:
                    at_base, heads = base, []
                if conv != at_conv:
                    if held:
                        done.append((*held, True))
                    at_conv, turn, held = conv, 0, (conv, 0, None, ROOT, 0)
                    if conv != base:
                        for h in heads[:head]:
                            held = grown(*h)
                if conv == base and turn < most_head:
                    heads.append((leaf, size))
                if conv == base or turn >= head:
                    held = grown(leaf, size)
                turn += 1
                if len(done) >= ROWS:
                    yield out()
        if held:
            done.append((*held, True))
        if done:
            yield out()

    return ordered.mapInArrow(task, PREFIX)


def screened(rows: DataFrame, width: int) -> DataFrame:
    """rows (checkpointed prefixes) with single (the sketch proves that the prefix is of one conversation) and under (its parent, too)."""
    again = rows.sparkSession.sparkContext.broadcast(countmin.counted(rows.select("digest"), width))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parents, digests = (batch.column(c).to_pylist() for c in ("parent", "digest"))
            own = countmin.proven_single(again.value, countmin.cells(digests, width))
            under = countmin.proven_single(again.value, countmin.cells([p or ROOT for p in parents], width)) & np.array([p is not None for p in parents])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own | under), pa.array(under)], [*batch.schema.names, "single", "under"])

    return rows.mapInArrow(task, PREFIX + ", single boolean, under boolean")


def ends_hashes(ends: DataFrame) -> DataFrame:
    """ends (digest, conv) -> digest, ends_sha256 of the ascending ids, joined by commas.

    Ranges of (digest, conv) are joined in chunks wherever they lie; a digest's chunks then stream through its hash.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, done = None, [], []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["digest", "first", "ids"])
            done.clear()
            return made

        for batch in batches:
            for digest, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest != at or len(ids) == CHUNK:
                    if ids:
                        done.append((at, ids[0], ",".join(map(str, ids))))
                    at, ids = digest, []
                ids.append(conv)
            if done:
                yield out()
        if ids:
            done.append((at, ids[0], ",".join(map(str, ids))))
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.binary(), pa.string()), strict=True)], ["digest", "ends_sha256"])
            done.clear()
            return made

        for batch in batches:
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest != at:
                    if state:
                        done.append((at, state.hexdigest()))
                    at, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield out()
        if state:
            done.append((at, state.hexdigest()))
            yield out()

    chunks = ends.repartitionByRange("digest", "conv").sortWithinPartitions("digest", "conv").mapInArrow(join, "digest binary, first long, ids string")
    return chunks.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(hashed, "digest binary, ends_sha256 string")


def nodes(prefix_rows: DataFrame, width: int | None = None) -> DataFrame:
    """The trie of prefixes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends, ends_sha256.

    width: cells of a row of the sketch, a power of two from 4,096; any width gives the same nodes.
    """
    rows = cut(prefix_rows)
    rows = cut(screened(rows, width or countmin.width_for(rows.count())))
    alone, shared = rows.where("single"), rows.where("NOT single")
    tops = alone.where("NOT under")

    # who owns a shared prefix, and from which depth on a conversation owns its prefixes
    owners = shared.groupBy("digest").agg(F.min("conv").alias("conv"), F.max("depth").alias("depth"), (F.count_if("last") == F.count("*")).alias("leaf"))
    owned = owners.select("conv", "depth", "leaf").unionByName(tops.select("conv", "depth", F.lit(True).alias("leaf")))
    own = owned.groupBy("conv").agg(F.min("depth").alias("owned_from"), F.max("leaf").alias("leaf"))
    joined = shared.join(own, "conv", "left")
    paid = F.when(F.col("owned_from").isNull() | (F.col("depth") < F.col("owned_from")), F.col("size")).otherwise(F.lit(0))
    below = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    grouped = cut(
        joined.withColumn("saved", F.sum(paid).over(below))
        .groupBy("digest")
        .agg(
            F.min("conv").alias("conv_id"),
            F.max("depth").alias("depth"),
            F.max("parent").alias("parent"),
            F.count("*").alias("n_convs"),
            F.count_if((F.col("owned_from") <= F.col("depth") + 1) & ~F.col("last")).alias("n_children"),
            F.count_if("leaf").alias("n_leaves"),
            F.sum("saved").alias("saved_tokens"),
            F.count_if("last").alias("n_ends"),
            F.min_by("owned_from", "conv").alias("owned_from"),
        )
    )
    ends = ends_hashes(shared.where("last").select("digest", "conv"))
    empty = F.sha2(F.lit(b""), 256)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    made = grouped.join(ends, "digest", "left").select(
        "conv_id", "depth", "parent", (F.col("depth") == F.col("owned_from")).alias("top"), "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", F.coalesce("ends_sha256", empty).alias("ends_sha256")
    )
    ended = F.col("last").cast("long")
    tails = alone.select(
        F.col("conv").alias("conv_id"), "depth", "parent", (~F.col("under")).alias("top"), one.alias("n_convs"), (1 - ended).alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), ended.alias("n_ends"),
        F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(empty).alias("ends_sha256"),
    )
    every = made.unionByName(tails)
    # below a node with the same owner the parent is the owner's; elsewhere it is asked for by its digest
    plain = every.where("NOT top OR depth = 0").select("*", F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id"))
    asked = every.where("top AND depth > 0")
    found = join_hot(asked, grouped.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children"), "parent", "n_children")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "ends_sha256")
    # a parent that isn't among the shared ones was proven single by its own parent: it has the same owner
    found = found.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
    return plain.select(*columns).unionByName(found.select(*columns))
