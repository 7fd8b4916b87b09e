"""SimHash near-dedup with BK-trees.

Fingerprints of any multiple of 64 bits are linked within a Hamming radius. Distinct fingerprints are dealt to shards of
about SHARD of them; every shard gets a BK-tree, in which each of its fingerprints is searched within the radius,
following only edges in reach. A shard emits a star per group it finds, not its pairs, and the stars of all shards are
joined up to components.

A shard is the fingerprints that agree in some bits, which one of several tables reads. The bits are cut into blocks, and a table
reads bits of all blocks but as many as the radius: whatever the errors, some table reads only untouched blocks, so no link is
lost. It reads as many bits as the number of fingerprints needs for shards of that size: for radius 3 of 64 bits, 4 tables
up to 16 bits each, and more and wider ones only beyond SHARD * 2 ** 16 fingerprints. So a search costs alike at every size.

No bucket is held whole. One of more than MOST fingerprints is dealt on to sub-shards by a hash, each with two fingerprints of
the bucket that all of them share, which joins what lies close together. Then the fingerprints of such a bucket that are not in its
largest component are searched in the trees of all its sub-shards, streaming past them, for links to other components.

The trees are not broadcast from the driver: they hold a fingerprint of every document, which has no size bound. Instead a
shard's tree is built in the task that its queries are sent to. The wide radius of `keep_one` has candidates of its own (`near_sets`).

Defined cases: a null or empty text has fingerprint zero and is linked like any other; rows that repeat a doc_id are rows of
their own in `near_groups`, and stay or go together in `keep_one` if their texts are equal too; a null doc_id takes
part, and a component of nulls alone has a null id; an empty table gives an empty result; extra columns are ignored by
`near_groups` and carried through by `keep_one`.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import near_sets
from tidemark.llm.bktree import Forest, join_up
from tidemark.llm.components import components
from tidemark.llm.shared import cut, utf8
from tidemark.llm.shingles import fingerprint, shingle_hashes

#: Fingerprints of a shard, about, and those above which a bucket is dealt on to sub-shards.
SHARD, MOST = 1024, 8192
#: Fingerprints that a task takes at once, at least.
ROWS = 100_000
#: Hot buckets that may be broadcast.
FEW = 10_000


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 3, bits: int = 64, seed: int = 42) -> DataFrame:
    """id, text_hash, fp (binary, little-endian) per row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(shingle_hashes(raw.as_py(), words, seed), bits // 64) for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["id", "text_hash", "fp"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), utf8(text).alias("raw"))
    return rows.mapInArrow(task, f"id {kind}, text_hash long, fp binary")


def exact_tables(bits: int, radius: int, count: int, shard: int = SHARD) -> list[np.ndarray]:
    """The bits that each table reads, for shards of about so many of count fingerprints."""
    need = max(0, math.ceil(math.log2(max(count, 1) / shard)))
    if not need:
        return [np.zeros(0, dtype=np.int64)]
    blocks = radius + 1
    while bits // blocks * (blocks - radius) < min(need, bits // 2):
        blocks += 1
    parts = np.array_split(np.arange(bits), blocks)
    return [np.concatenate(kept)[:need] for kept in itertools.combinations(parts, blocks - radius)]


def dealt(distinct: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """t, v (what table t reads), fp: every fingerprint once per table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, column = batch.num_rows, batch.column(0)
            if not n:
                continue
            unpacked = np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(n, -1), axis=1, bitorder="little")
            for t, at in enumerate(tables):
                value = unpacked[:, at].astype(np.int64) @ (np.int64(1) << np.arange(len(at), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, dtype=np.int32)), pa.array(value), column], ["t", "v", "fp"])

    return distinct.select("fp").mapInArrow(task, "t int, v long, fp binary")


def shard_links(shards: DataFrame, width: int, radius: int) -> DataFrame:
    """Links (a, b) between fingerprints of a shard (t, v, sub) at most radius apart: of each shard a star per group."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in near_sets.groups(batches, ["t", "v", "sub"], ROWS):
            column = table.column("fp").combine_chunks()
            items = np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, width)
            label = join_up(len(items), Forest(items, starts).pairs(radius))
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([column.take(pa.array(moved)), column.take(pa.array(label[moved]))], ["a", "b"])

    return shards.repartition(F.col("t"), F.col("v"), F.col("sub")).sortWithinPartitions("t", "v", "sub").mapInArrow(task, "a binary, b binary")


def cross_links(cells: DataFrame, width: int, radius: int) -> DataFrame:
    """Links between components of a hot bucket: kind 1 (queries) streams past the tree of kind 0 of its sub-shard."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, tree, held, roots = None, None, [], None
        for batch in batches:
            t, v, sub, kind = (batch.column(c).to_numpy() for c in ("t", "v", "sub", "kind"))
            edges = np.flatnonzero((t[1:] != t[:-1]) | (v[1:] != v[:-1]) | (sub[1:] != sub[:-1]) | (kind[1:] != kind[:-1])) + 1
            for begin, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if begin == end:
                    continue
                if cell != (t[begin], v[begin], sub[begin]):
                    cell, tree, held = (t[begin], v[begin], sub[begin]), None, []
                part = batch.slice(begin, end - begin)
                if kind[begin] == 0:
                    held.append(part)
                    continue
                if tree is None:
                    if not held:  # no fingerprint was dealt to this sub-shard
                        continue
                    whole = pa.Table.from_batches(held)
                    prints, roots = whole.column("fp").to_pylist(), whole.column("root").to_pylist()
                    tree = Forest(np.frombuffer(b"".join(prints), dtype="<u8").reshape(-1, width), np.zeros(1, dtype=np.int64))
                asked, own = part.column("fp").to_pylist(), part.column("root").to_pylist()
                queries = np.frombuffer(b"".join(asked), dtype="<u8").reshape(-1, width)
                found = {}
                for i, j in tree.search(queries, np.zeros(len(queries), dtype=np.int64), radius):
                    found |= {(own[x], roots[y]): (asked[x], prints[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if own[x] != roots[y]}
                if found:
                    a, b = zip(*found.values(), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    spread = cells.repartition(F.col("t"), F.col("v"), F.col("sub")).sortWithinPartitions("t", "v", "sub", "kind")
    return spread.mapInArrow(task, "a binary, b binary")


def linked_up(distinct: DataFrame, bits: int, radius: int, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """distinct (checkpointed fp) -> (node, root) of the components of all links within the radius."""
    width, buckets = bits // 64, dealt(distinct, exact_tables(bits, radius, distinct.count(), shard))
    size = F.count("*")
    hot = cut(buckets.groupBy("t", "v").agg(size.alias("size"), F.array(F.min("fp"), F.max("fp")).alias("shared")).where(F.col("size") > most))
    hot = hot.withColumn("subs", F.ceil(F.col("size") / F.lit(most // 2)).cast("int"))
    number = hot.count()
    if not number:
        return components(shard_links(buckets.withColumn("sub", F.lit(0)), width, radius))
    small = F.broadcast if number <= FEW else lambda df: df
    sub = F.coalesce(F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"), F.lit(0)).alias("sub")
    placed = buckets.join(small(hot.select("t", "v", "subs")), ["t", "v"], "left").select("t", "v", sub, "subs", "fp")
    every = F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")
    shared = hot.select("t", "v", every, "shared").select("t", "v", "sub", F.explode("shared").alias("fp"))
    links = cut(shard_links(placed.drop("subs").unionByName(shared), width, radius))
    roots = components(links)
    rooted = placed.where("subs IS NOT NULL").join(roots, F.col("fp") == F.col("node"), "left").select("t", "v", "sub", "subs", "fp", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    parts = rooted.groupBy("t", "v", "root").agg(size.alias("n")).groupBy("t", "v").agg(size.alias("parts"), F.max_by("root", F.struct("n", "root")).alias("largest"))
    apart = rooted.join(small(parts.where("parts > 1").select("t", "v", "largest")), ["t", "v"])
    asked = apart.where("root <> largest").select("t", "v", every, "fp", "root", F.lit(1).alias("kind"))
    cells = apart.select("t", "v", "sub", "fp", "root", F.lit(0).alias("kind")).unionByName(asked)
    more = cut(cross_links(cells, width, radius))
    return roots if more.isEmpty() else components(links.unionByName(more))


def grouped(prints: DataFrame, bits: int, radius: int, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """prints (checkpointed rows with fp) -> distinct fp with the root fingerprint of its component."""
    distinct = cut(prints.select("fp").distinct())
    roots = linked_up(distinct, bits, radius, shard, most)
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 3, bits: int = 64, radius: int = 3, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """id_col, fp and component_id (the smallest id reachable) per row."""
    prints = cut(fingerprints(docs, text_col, id_col, words, bits))
    group = grouped(prints, bits, radius, shard, most)
    smallest = prints.groupBy("fp").agg(F.min("id").alias("id")).join(group, "fp").groupBy("root").agg(F.min("id").alias("component_id"))
    named = group.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, bits: int = 512, radius: int = 132, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each near-duplicate group, the one with the smallest id.

    Groups are the components of the pairs whose shingle sets have a Jaccard similarity of at least `similarity`, counted
    on the sets themselves (`near_sets.grouped_sets`).
    """
    prints = cut(near_sets.set_prints(docs, text_col, id_col, words, bits))
    group = near_sets.grouped_sets(docs, prints, text_col, words, bits, radius, similarity)
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"))
    rows = prints.select("key", place.alias("place"))
    first = rows.groupBy("key").agg(F.min("place").alias("place")).join(group, "key").groupBy("root").agg(F.min("place").alias("keep"))
    named = group.join(first, "root").select("key", "keep")
    gone = rows.join(named, "key").where(~F.col("place").eqNullSafe(F.col("keep"))).select("place.*").distinct()
    gone = gone.select(F.col("id").alias("__gone_id"), F.col("text_hash").alias("__gone_hash"))
    same = docs[id_col].eqNullSafe(gone["__gone_id"]) & (F.xxhash64(docs[text_col]) == gone["__gone_hash"])
    return docs.join(gone, same, "left_anti")
