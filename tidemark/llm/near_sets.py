"""Groups of texts by the exact Jaccard similarity of their shingle sets.

A text is its set of shingles; equal sets are one node from the start. Candidates meet by min-hash: each of BANDS tables
puts a node in the bucket of READ minima, which two sets of Jaccard similarity J share with probability J ** READ, so a
pair at 0.8 meets with 1 - (1 - 0.8 ** 6) ** 27 = 0.9997, whatever the number of rows. Within a bucket, pairs are kept whose
SimHash fingerprints (of the sets) lie within a radius and whose sizes allow the similarity. Every candidate is then
counted on the two whole sets, and only what reaches the similarity links.

The radius: sets of J = 0.8 differ in acos(2J / (1 + J)) / pi of the bits or less, 78 of 512; the smallest sets, where the
normal law doesn't hold, in up to 3/16 (four shingles of five), 96 of 512 with a deviation of 9. The default of 132 is four
deviations above that.

No bucket is held whole. It is read in blocks of BLOCK nodes, and up to LEADERS of its nodes stand for it: each other node is
first a candidate with the nearest of those only, which joins a large group of near copies by as many candidates as it has members. After
these are counted, buckets that are still of several components are searched again, each block in a group of its own: strays, the
members outside of their bucket's largest component, visit every block of it. First this finds which members are near one of
another component; the sets of these only are fetched and counted there, and only links come out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bktree import Forest, distance
from tidemark.llm.components import components
from tidemark.llm.hot_join import join_hot
from tidemark.llm.shared import cut, utf8
from tidemark.llm.shingles import fingerprint, shingle_hashes

BANDS, READ = 27, 6
#: Nodes of a bucket that are searched together.
BLOCK = 1024
#: Nodes that stand for a bucket. A bucket of no more than so many is searched whole.
LEADERS = 8
#: A node no further than this from a leader isn't compared with the next leaders (in bits of 512).
CLOSE = 60
#: Nodes that a bucket task takes at once, at least.
ROWS = 50_000
#: The same with the sets.
CELL_ROWS = 4_000
#: Texts or hashes taken at once.
STEP = 500


def shingle_set(raw: bytes, words: int, seed: int = 42) -> np.ndarray:
    return np.unique(shingle_hashes(raw, words, seed))


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def bands(hashes: np.ndarray, seed: int = 7) -> bytes:
    """A number for each band, which sets with the same minima share; nothing for an empty set."""
    if not len(hashes):
        return b""
    random = np.random.default_rng(seed)
    flip, odd = random.integers(0, 2**64, (2, BANDS * READ), dtype=np.uint64)
    odd |= np.uint64(1)
    least = np.full(BANDS * READ, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), STEP):
        least = np.minimum(least, ((hashes[at : at + STEP, None] ^ flip) * odd).min(axis=0))
    rows = least.astype("<u8").reshape(BANDS, READ)
    return b"".join(xxhash.xxh64_digest(row.tobytes(), k) for k, row in enumerate(rows))


def set_prints(docs: DataFrame, text_col: str, id_col: str, words: int, bits: int) -> DataFrame:
    """id, text_hash, key (of the shingle set), n (its size), fp and bands per row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prints, found = [], [], [], []
            for raw in batch.column(2):
                own = shingle_set(raw.as_py(), words)
                keys.append(set_key(own))
                sizes.append(len(own))
                prints.append(fingerprint(own, bits // 64))
                found.append(bands(own))
            made = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "text_hash", "key", "n", "fp", "bands"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), utf8(text).alias("raw"))
    return rows.mapInArrow(task, f"id {kind}, text_hash long, key binary, n int, fp binary, bands binary")


def bucket_members(nodes: DataFrame) -> DataFrame:
    """v, block, key, n, fp: the nodes of every bucket of two or more, in the order of v and key, and their place in blocks."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                part = batch.slice(low, STEP)
                found = [np.frombuffer(b, dtype="<i8") for b in part.column("bands").to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                kept = [part.column(c).take(at) for c in ("key", "n", "fp")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64)), *kept], ["v", "key", "n", "fp"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, 0  # the last row, and how many of its bucket came before it
        for batch in itertools.chain(batches, [None]):
            parts = [x for x in (held, batch) if x is not None and x.num_rows]
            if not parts:
                continue
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            n, v = whole.num_rows, whole.column("v").to_numpy()
            new = np.append(True, v[1:] != v[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            place = np.arange(n) - start + np.where(start == 0, before, 0)
            many = (place > 0) | np.append(~new[1:], False)
            if batch is not None:
                many[-1] = False
                held, before = whole.slice(n - 1), int(place[-1])
            else:
                held = None
            if many.any():
                kept = whole.filter(pa.array(many))
                yield pa.RecordBatch.from_arrays([kept.column("v"), pa.array((place[many] // BLOCK).astype(np.int32)), *kept.columns[1:]], ["v", "block", "key", "n", "fp"])

    dealt = nodes.select("key", "n", "fp", "bands").mapInArrow(deal, "v long, key binary, n int, fp binary")
    return dealt.repartition(F.col("v")).sortWithinPartitions("v", "key").mapInArrow(several, "v long, block int, key binary, n int, fp binary")


def groups(batches: Iterator[pa.RecordBatch], names: list[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (runs of equal names) and where each group begins."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows
            if rows < least:
                continue
        if not rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(rows, dtype=bool)
        new[0] = True
        for name in names:
            x = whole.column(name).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        end = rows if batch is None else int(starts[-1])  # the last group may go on
        if end:
            yield whole.slice(0, end), starts[starts < end]
        held, rows = whole.slice(end).to_batches(), rows - end


def _items(table: pa.Table, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("fp").to_pylist()), dtype="<u8").reshape(-1, width)


def leader_pairs(members: DataFrame, width: int, radius: int, similarity: float) -> DataFrame:
    """Candidates (a, b): all of a small bucket, the nearest leader of each node of a larger one. members: in their order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, leaders = None, []
        for table, starts in groups(batches, ["v", "block"], ROWS):
            items, n, keys = _items(table, width), table.column("n").to_numpy().astype(np.int64), table.column("key").to_pylist()
            v, block = table.column("v").to_numpy(), table.column("block").to_numpy()
            ends = np.append(starts[1:], table.num_rows)
            small = (ends - starts <= LEADERS) & (block[starts] == 0)
            a, b = [], []
            if small.any():
                rows = np.flatnonzero(np.repeat(small, ends - starts))
                sizes = (ends - starts)[small]
                for i, j in Forest(items[rows], np.append(0, np.cumsum(sizes)[:-1])).pairs(radius):
                    i, j = rows[i], rows[j]
                    fits = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
                    a += [keys[k] for k in i[fits]]
                    b += [keys[k] for k in j[fits]]
            for low, high in zip(starts[~small], ends[~small], strict=True):
                if v[low] != bucket:
                    bucket, leaders = v[low], []
                rest, k = np.arange(low, high), 0
                near, whose = np.full(high - low, radius + 1), np.zeros(high - low, dtype=np.int64)
                while len(rest):
                    if k == len(leaders):
                        if k == LEADERS:
                            break
                        leaders.append((items[rest[0]], n[rest[0]], keys[rest[0]]))
                        rest = rest[1:]
                    own, size, _ = leaders[k]
                    d = distance(items[rest], own[None])
                    fits = (d < near[rest - low]) & (np.minimum(n[rest], size) >= similarity * np.maximum(n[rest], size))
                    near[rest[fits] - low], whose[rest[fits] - low] = d[fits], k
                    rest, k = rest[d > CLOSE * width // 8], k + 1
                found = np.flatnonzero(near <= radius)
                a += [keys[low + x] for x in found]
                b += [leaders[x][2] for x in whose[found]]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return _ordered(members.mapInArrow(task, "a binary, b binary"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets of more than LEADERS that are still of several components, with their root (roots: node, root) and whether they are strays.

    Strays are members outside of their bucket's largest component (the one with the greatest root on a tie).
    """
    rooted = members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    parts = rooted.groupBy("v", "root").agg(F.count("*").alias("size"), F.max("block").alias("last"))
    buckets = parts.groupBy("v").agg(F.sum("size").alias("size"), F.max("last").alias("last"), F.count("*").alias("parts"), F.max_by("root", F.struct("size", "root")).alias("largest"))
    apart = cut(buckets.where((F.col("size") > LEADERS) & (F.col("parts") > 1)).select("v", "size", "last", "largest"))
    found = join_hot(rooted, apart, "v", "size").where("largest IS NOT NULL")
    return found.withColumn("stray", F.col("root") != F.col("largest")).drop("largest")


def cells(left: DataFrame) -> DataFrame:
    """v, at (a block), stray, key, n, fp, root: unsettled members in their own block, and strays in every block of their bucket.

    A pair of different components has a stray, so it meets in the block of its other one.
    """
    visits = left.where("stray").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("last")))).where("at <> block")
    every = left.withColumn("at", F.col("block")).unionByName(visits)
    return every.select("v", "at", (F.col("at") != F.col("block")).alias("visits"), "stray", "key", "n", "fp", "root")


def _candidates(table: pa.Table, starts: np.ndarray, width: int, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a cell, of different components and near enough, of which one is a stray and one at home."""
    items, n, roots = _items(table, width), table.column("n").to_numpy().astype(np.int64), table.column("root").to_pylist()
    stray, visits = (table.column(c).to_numpy(zero_copy_only=False) for c in ("stray", "visits"))
    number = {r: k for k, r in enumerate(set(roots))}
    root = np.array([number[r] for r in roots])
    bucket = np.repeat(starts, np.diff(np.append(starts, len(items))))
    asked = np.flatnonzero(stray)
    for i, j in Forest(items, starts).search(items[asked], bucket[asked], radius):
        i = asked[i]
        fits = (root[i] != root[j]) & ~(visits[i] & visits[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
        yield i[fits], j[fits]


def close_members(laid: DataFrame, width: int, radius: int, similarity: float) -> DataFrame:
    """The rows of cells that are near one of another component: only of these are sets needed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, ["v", "at"], ROWS):
            some = np.zeros(table.num_rows, dtype=bool)
            for i, j in _candidates(table, starts, width, radius, similarity):
                some[i] = some[j] = True
            if some.any():
                yield from table.filter(pa.array(some)).combine_chunks().to_batches()

    return laid.repartition(F.col("v"), F.col("at")).sortWithinPartitions("v", "at", "key").mapInArrow(task, laid.schema)


def other_links(close: DataFrame, sets: DataFrame, width: int, radius: int, similarity: float) -> DataFrame:
    """Links (a, b) between components, counted on whole sets in each cell: a task gives one per two components that it joins."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[bytes, bytes] = {}  # of roots that this task has joined

        def top(x: bytes) -> bytes:
            while x in up:
                x = up[x]
            return x

        for table, starts in groups(batches, ["v", "at"], CELL_ROWS):
            n, keys, roots = table.column("n").to_numpy().astype(np.int64), table.column("key").to_pylist(), table.column("root").to_pylist()
            lists = pa.concat_arrays(table.column("shingles").chunks)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            a, b = [], []
            for i, j in _candidates(table, starts, width, radius, similarity):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    own, his = top(roots[x]), top(roots[y])
                    if own == his:
                        continue
                    common = len(np.intersect1d(values[ends[x] : ends[x + 1]], values[ends[y] : ends[y + 1]], assume_unique=True))
                    if common / (int(n[x]) + int(n[y]) - common) >= similarity:
                        up[own] = his
                        a.append(keys[x])
                        b.append(keys[y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    rows = close.join(sets, "key")
    return rows.repartition(F.col("v"), F.col("at")).sortWithinPartitions("v", "at", "key").mapInArrow(task, "a binary, b binary")


def shingle_sets(docs: DataFrame, prints: DataFrame, keys: DataFrame, text_col: str, words: int) -> DataFrame:
    """key and shingles of the distinct keys, made from the texts again."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                sets = [shingle_set(raw.as_py(), words) for raw in batch.column(0).slice(low, STEP)]
                keys = pa.array([set_key(x) for x in sets], pa.binary())
                ends = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["key", "shingles"])

    wanted = prints.groupBy("key").agg(F.min("text_hash").alias("__near_hash")).join(keys, "key").select("__near_hash").distinct()
    texts = docs.select(utf8(F.col(text_col)).alias("raw"), F.xxhash64(text_col).alias("__near_hash")).join(wanted, "__near_hash", "left_semi")
    once = texts.groupBy("__near_hash").agg(F.first("raw").alias("raw")).select("raw")
    return cut(once.mapInArrow(task, "key binary, shingles array<long>").dropDuplicates(["key"]))


def linked(docs: DataFrame, prints: DataFrame, pairs: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of keys those whose sets have the similarity."""
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = shingle_sets(docs, prints, keys, text_col, words)
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common / (F.size("x") + F.size("y") - common) >= similarity).select("a", "b")


def grouped_sets(docs: DataFrame, prints: DataFrame, text_col: str, words: int, bits: int, radius: int, similarity: float) -> DataFrame:
    """prints (checkpointed) -> key with the root key of its component."""
    width = bits // 64
    nodes = prints.dropDuplicates(["key"])
    members = cut(bucket_members(nodes))
    pairs = cut(leader_pairs(members, width, radius, similarity))
    links = cut(linked(docs, prints, pairs, text_col, words, similarity))
    roots = components(links)
    left = cut(unsettled(members, roots))
    if not left.isEmpty():
        close = cut(close_members(cells(left), width, radius, similarity))
        sets = shingle_sets(docs, prints, close.select("key").distinct(), text_col, words)
        more = cut(other_links(close, sets, width, radius, similarity))
        if not more.isEmpty():
            roots = components(links.unionByName(more))
    keys = nodes.select("key")
    return keys.join(roots, keys.key == roots.node, "left").select("key", F.coalesce("root", "key").alias("root"))
