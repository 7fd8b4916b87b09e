"""A count-min sketch that counts to two: enough to prove that a digest was seen once.

Each of ROWS rows has `width` cells. A digest adds one to a cell per row; its estimate is the least of its cells, which
is never below its count. So an estimate of one proves a singleton, however full the sketch is.

Tasks count on their own and emit slabs of cells as two bit strings (seen, seen again), which are merged per slab as they
stream past. The width follows the number of digests up to MOST_WIDTH, beyond which estimates get worse, not wrong: the
whole sketch is ROWS * MOST_WIDTH bits, 8 MB, which is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: One row for each four bytes of a digest of 16.
ROWS = 4
LEAST_WIDTH, MOST_WIDTH = 1 << 12, 1 << 24
SLAB = 1 << 18


def width_for(digests: int) -> int:
    """Four cells for each digest, within the bounds."""
    return min(MOST_WIDTH, max(LEAST_WIDTH, 1 << max(0, 4 * digests - 1).bit_length()))


def cells(digests: list[bytes], width: int) -> np.ndarray:
    """(digests, ROWS): the cell of every digest in every row."""
    return np.frombuffer(b"".join(digests), dtype="<u4").reshape(-1, ROWS) & np.uint32(width - 1)


def counted(digests: DataFrame, width: int) -> np.ndarray:
    """digests (one binary column of 16 bytes) -> (ROWS, width / 8) bits of the cells that were seen again."""
    slab = min(SLAB, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((ROWS, width), dtype=np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = cells(batch.column(0).to_pylist(), width)
            for r in range(ROWS):
                cell, times = np.unique(at[:, r], return_counts=True)
                seen[r, cell] = np.minimum(2, seen[r, cell] + np.minimum(times, 2))
        for r in range(ROWS):
            for s in range(width // slab):
                part = seen[r, s * slab : (s + 1) * slab]
                if part.any():
                    bits = [pa.array([np.packbits(part >= k).tobytes()], pa.binary()) for k in (1, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array([r * (width // slab) + s], pa.int32()), *bits], ["slab", "once", "again"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, again = None, None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([again.tobytes()], pa.binary())], ["slab", "again"])
        for batch in batches:
            for s, o, a in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o, a = np.frombuffer(o, dtype=np.uint8), np.frombuffer(a, dtype=np.uint8)
                if s != at:
                    if at is not None:
                        yield done()
                    at, once, again = s, o, a
                else:
                    once, again = once | o, again | a | (once & o)
        if at is not None:
            yield done()

    parts = digests.mapInArrow(count, "slab int, once binary, again binary").repartition("slab").sortWithinPartitions("slab")
    bits = np.zeros((ROWS, width // slab, slab // 8), dtype=np.uint8)
    merged = parts.mapInArrow(merge, "slab int, again binary").toArrow()
    for s, again in zip(*(merged.column(c).to_pylist() for c in ("slab", "again")), strict=True):
        bits[s // (width // slab), s % (width // slab)] = np.frombuffer(again, dtype=np.uint8)
    return bits.reshape(ROWS, width // 8)


def proven_single(again: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the estimate of digests with these cells is one: some cell of theirs was seen once only."""
    bit = [(again[r, at[:, r] >> 3] >> (7 - (at[:, r] & 7)).astype(np.uint8)) & 1 for r in range(ROWS)]
    return ~np.all(bit, axis=0)
