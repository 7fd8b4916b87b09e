"""Groups of near hashes, by representative and membership, with exact numbers of near ones; pairs are never listed.

Hashes that repeat are one from the start. The 64 bits are cut into more parts than the radius: two hashes within it agree
in some part. So there is a table per part, whatever the number of hashes, and a bucket per value of it; a pair counts in
the first table where it agrees. A table has at most 8,192 buckets, whose sizes are known to all tasks. A bucket of more than BLOCK hashes is dealt on to blocks by a hash: of each two blocks one visits the other.

A block's hashes are held, and visitors stream past them; both are compared tile by tile. It gives per hash how many are near
there and one that it is joined with: rows that grow with the hashes, not with pairs, and add up to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.constants import NO_HASH
from tidemark.functions.hashing import as_long
from tidemark.operators.components import components
from tidemark.shared import cut

BITS = 64
#: Parts, at least: a table has a bucket for each value of its part.
LEAST = 5
#: Hashes of a block, about, and cells of a tile.
BLOCK, TILE = 16_384, 1 << 20


def parts(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the parts that the bits are cut into: more than the radius, and none wider than 13 bits."""
    many = max(radius + 1, LEAST)
    edges = [k * BITS // many for k in range(many + 1)]
    return [(BITS - b, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def visits(own, other):
    """Of two different numbers one visits the other; of numbers or arrays."""
    return (own != other) & ((own > other) == ((own + other) % 2 == 0))


class Near:
    """Counts and joins near ones among held and passing hashes of table t."""

    def __init__(self, held: np.ndarray, radius: int, masks: list[np.uint64], t: int):
        self.held, self.radius, self.earlier = held, radius, masks[:t]
        self.count = np.zeros(len(held), dtype=np.int64)
        self.label = np.arange(len(held))

    def _join(self, label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = label[i], label[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while ((up := label[label]) != label).any():
                label[:] = up

    def passed(self, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(count, label) of the passing hashes: how many held ones are near, and the held one that each is joined with; None: the held ones themselves."""
        own = hashes is None
        other = self.held if own else hashes
        n, m = len(self.held), len(other)
        count, label = np.zeros(m, dtype=np.int64), np.append(self.label, n + np.arange(0 if own else m))
        step = max(1, TILE // max(1, n))
        for at in range(0, m, step):
            x = other[at : at + step, None] ^ self.held[None, :]
            i, j = np.nonzero(np.bitwise_count(x) <= self.radius)
            if own:
                keep = i + at != j
                i, j = i[keep], j[keep]
            self._join(label, i + at + (0 if own else n), j)
            for mask in self.earlier:  # what agrees there was counted there
                apart = (x[i, j] & mask) != 0
                i, j = i[apart], j[apart]
            count[at : at + step] += np.bincount(i, minlength=len(count[at : at + step]))
            if not own:
                self.count += np.bincount(j, minlength=n)
        self.label = label[:n]
        if own:
            self.count += count
        return count, label[n:]


def _dealt(tables: DataFrame, blocks: list[np.ndarray]) -> DataFrame:
    """tables (t, v, h) -> t, v, block, kind (0: at home, 1: visiting), h."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t, v, h = (batch.column(c).to_numpy() for c in ("t", "v", "h"))
            many = np.array([blocks[a][b] for a, b in zip(t.tolist(), v.tolist(), strict=True)])
            mixed = (h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            home = (mixed % many.astype(np.uint64)).astype(np.int64)
            for b in range(int(many.max())):
                for kind, at in ((0, np.flatnonzero(home == b)), (1, np.flatnonzero(visits(home, b) & (b < many)))):
                    if len(at):
                        columns = (t[at], v[at], np.full(len(at), b, dtype=np.int32), np.full(len(at), kind, dtype=np.int32), h[at])
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t", "v", "block", "kind", "h"])

    return tables.mapInArrow(task, "t int, v long, block int, kind int, h long")


def _counted(cells: DataFrame, radius: int) -> DataFrame:
    """cells -> h, near (one that it is joined with, maybe itself), n (near ones), of every block."""
    masks = [np.uint64(((1 << width) - 1) << shift) for shift, width in parts(radius)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, near, held = None, None, []

        def out(h: np.ndarray, joined: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            some = (n > 0) | (h != joined)
            return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(joined[some].view(np.int64)), pa.array(n[some])], ["h", "near", "n"])

        def settled() -> Near | None:
            if not held:
                return None
            made = Near(np.concatenate(held), radius, masks, at[0])
            made.passed()
            return made

        for batch in batches:
            t, v, block, kind, h = (batch.column(c).to_numpy() for c in ("t", "v", "block", "kind", "h"))
            h = h.view(np.uint64)
            edges = np.flatnonzero((t[1:] != t[:-1]) | (v[1:] != v[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
            for begin, end in zip([0, *edges], [*edges, len(h)], strict=True):
                if begin == end:
                    continue
                if at != (t[begin], v[begin], block[begin]):
                    if near := near or settled():
                        yield out(near.held, near.held[near.label], near.count)
                    at, near, held = (t[begin], v[begin], block[begin]), None, []
                if kind[begin] == 0:
                    held.append(h[begin:end])
                elif near := near or settled():  # else nobody is at home
                    count, label = near.passed(h[begin:end])
                    found = label < len(near.held)
                    yield out(h[begin:end][found], near.held[label[found]], count[found])
        if near := near or settled():
            yield out(near.held, near.held[near.label], near.count)

    return cells.repartition("t", "v", "block").sortWithinPartitions("t", "v", "block", "kind").mapInArrow(task, "h long, near long, n long")


def near_groups(hashes: DataFrame, radius: int = 6, block: int = BLOCK) -> DataFrame:
    """hash, frames, n_near (other distinct hashes within the radius), group_hash (the least hash reachable) per distinct usable hash."""
    counted = cut(hashes.where(F.col("hash") != NO_HASH).groupBy("hash").agg(F.count("*").alias("frames")).withColumn("h", as_long(F.col("hash"))))
    cuts = parts(radius)
    value = lambda shift, width: F.shiftrightunsigned("h", shift).bitwiseAND((1 << width) - 1)
    tables = counted.select(F.posexplode(F.array(*[value(*p) for p in cuts])).alias("t", "v"), "h")
    sizes = [np.zeros(1 << width, dtype=np.int64) for _, width in cuts]
    for r in tables.groupBy("t", "v").count().collect():  # a row per value of a part
        sizes[r["t"]][r["v"]] = r["count"]
    near = cut(_counted(_dealt(tables, [np.maximum(1, -(-s // block)) for s in sizes]), radius))
    roots = components(near.select(F.col("h").alias("a"), F.col("near").alias("b")))
    known = counted.join(near.groupBy("h").agg(F.sum("n").alias("n")), "h", "left").join(roots, F.col("h") == F.col("node"), "left").withColumn("root", F.coalesce("root", "h"))
    least = known.groupBy("root").agg(F.min("hash").alias("group_hash"))
    return known.join(least, "root").select("hash", "frames", F.coalesce("n", F.lit(0)).alias("n_near"), "group_hash")
