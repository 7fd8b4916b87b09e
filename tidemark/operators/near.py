"""Perceptually near frames: the bounded cache in arrival order, and all near pairs of distinct hashes."""

from __future__ import annotations

import itertools
import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.constants import CACHE_FRAMES, NO_HASH
from tidemark.functions.hashing import as_long

BITS = 64
#: Distinct hashes that share what a table of `near_pairs` reads, about.
MEET = 8


class Cache:
    """The last scored hashes of a video."""

    def __init__(self, threshold: int, capacity: int, held: Iterator[tuple[int, float]] = ()):
        self.threshold, self.held = threshold, deque(held, maxlen=capacity)

    def judge(self, bits: int, score: float) -> tuple[float, bool]:
        """The score that a frame gets, and whether it is inherited: from the nearest held one within the threshold, the newest on a tie."""
        near = min((((bits ^ h).bit_count(), -k) for k, (h, _) in enumerate(self.held)), default=None) if bits else None
        if near is not None and near[0] <= self.threshold:
            return self.held[-near[1]][1], True
        if bits:
            self.held.append((bits, score))
        return score, False


def cached_scores(frames: DataFrame, threshold: int = 6, capacity: int = CACHE_FRAMES) -> DataFrame:
    """video_id, arrival, score, inherited: in arrival order a frame takes the score of the nearest of the last `capacity`
    frames that were scored themselves, if it is within the threshold (the newest on a tie); else its own score counts
    and it enters the cache. Frames without a usable hash neither ask nor enter.

    A video's frames stream past its cache in their order, and the cache is all that is held of it, however many there are.
    """
    kind = frames.schema["video_id"].dataType.simpleString()
    rows = frames.select("video_id", F.col("arrival").cast("long").alias("arrival"), as_long(F.coalesce("hash", F.lit(NO_HASH))).alias("h"), F.col("score").cast("double").alias("score"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, cache = None, None
        for batch in batches:
            ids, _, bits, scores = (c.to_pylist() for c in batch.columns)
            out = []
            for v, h, s in zip(ids, bits, scores, strict=True):
                if cache is None or v != video:
                    video, cache = v, Cache(threshold, capacity)
                out.append(cache.judge(h % 2**BITS, s))
            got, hit = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array(hit, pa.bool_())], ["video_id", "arrival", "score", "inherited"])

    ordered = rows.repartition(F.col("video_id")).sortWithinPartitions("video_id", "arrival")
    return ordered.mapInArrow(fold, f"video_id {kind}, arrival long, score double, inherited boolean")


def key_tables(radius: int, count: int) -> list[tuple[tuple[int, int], ...]]:
    """Tables of bit ranges (shift, width). Whatever `radius` bits differ, two hashes agree in all ranges of some table.

    The bits are cut into blocks, of which `radius` may be touched; a table reads as many of the others as the number of hashes needs.
    """
    blocks, need = radius + 1, math.log2(max(count, 1) / MEET)
    while (blocks - radius) * (BITS // blocks) < min(need, BITS // 2) and blocks < BITS:
        blocks += 1
    edges = [k * BITS // blocks for k in range(blocks + 1)]
    parts = [(BITS - edges[k + 1], edges[k + 1] - edges[k]) for k in range(blocks)]
    return list(itertools.combinations(parts, blocks - radius))


def near_pairs(hashes: DataFrame, radius: int = 6) -> DataFrame:
    """hash_a < hash_b, distance, frames_a, frames_b: distinct usable hashes within the radius, copies counted, not paired.

    Two hashes meet where they agree in what some table reads; the tables read more bits the more hashes there are, so that
    about MEET meet by chance. Hashes that repeat are one row with their number of frames from the start.
    """
    counted = hashes.where(F.col("hash") != NO_HASH).groupBy("hash").agg(F.count("*").alias("frames")).withColumn("h", as_long(F.col("hash")))
    tables = key_tables(radius, counted.count())
    part = lambda shift, width: F.shiftrightunsigned("h", shift).bitwiseAND((1 << width) - 1)
    keys = []
    for table in tables:
        key = F.lit(0).cast("long")
        for shift, width in table:
            key = F.shiftleft(key, width).bitwiseOR(part(shift, width))
        keys.append(key)
    laid = counted.select("hash", "h", "frames", F.posexplode(F.array(*keys)).alias("t", "bits"))
    a, b = laid.alias("a"), laid.alias("b")
    met = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.hash") < F.col("b.hash")))
    distance = F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h"))).cast("long")
    found = met.where(distance <= radius).select(
        F.col("a.hash").alias("hash_a"), F.col("b.hash").alias("hash_b"), distance.alias("distance"), F.col("a.frames").alias("frames_a"), F.col("b.frames").alias("frames_b")
    )
    return found.dropDuplicates(["hash_a", "hash_b"])
