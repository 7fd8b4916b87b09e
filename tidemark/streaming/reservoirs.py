"""Histograms of a stream of timings: of every name the last values, in bounded state.

The state of a (name, shard) is its last `reservoir` values by their number, in whatever order they come, with the count and the
highest of all; shards, by a hash of the number, let one name with a third of all rows use several tasks. Among the last values
of all shards are the last values of the name, so the shards are merged where histograms are read.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.constants import RESERVOIR
from tidemark.operators.metrics import last_values, snapshot
from tidemark.shared import shared_folder
from tidemark.streaming.progress import drained

SHARDS = 8
LATE = "late array<struct<seq: long, ms: double>>"


class ReservoirProcessor(StatefulProcessor):
    """Rows (seq, ms) of a (name, shard) -> its last values, count and highest, in one row whenever they changed."""

    def __init__(self, reservoir: int):
        self.reservoir = reservoir

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.late = handle.getListState("late", "seq long, ms double")
        self.whole = handle.getValueState("whole", "n long, most double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, most = self.whole.get() or (0, None)
        held = [(s, v) for s, v in self.late.get()]
        for r in rows:
            v = r["ms"]
            if v is None or not math.isfinite(v) or v < 0:
                continue
            n, most = n + 1, v if most is None else max(most, v)
            # a heap of the last values, the first of them on top
            if len(held) < self.reservoir:
                heapq.heappush(held, (r["seq"], v))
            else:
                heapq.heappushpop(held, (r["seq"], v))
        if n:
            heapq.heapify(held)
            self.late.put(held)
            self.whole.update((n, most))
            yield Row(name=key[0], shard=key[1], late=sorted(held), count=n, max=most)

    def close(self) -> None:
        pass


def reservoirs(timings: DataFrame, reservoir: int = RESERVOIR, shards: int = SHARDS) -> DataFrame:
    """name, shard, late, count, max from a stream of timings (name, seq, ms), in update mode."""
    kind = timings.schema["name"].dataType.simpleString()
    rows = timings.select("name", F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int").alias("shard"), F.col("seq").cast("long").alias("seq"), F.col("ms").cast("double").alias("ms"))
    return rows.groupBy("name", "shard").transformWithState(ReservoirProcessor(reservoir), f"name {kind}, shard int, {LATE}, count long, max double", "Update", "None")


def histograms(timings: DataFrame, folder: str | None = None, reservoir: int = RESERVOIR, shards: int = SHARDS) -> DataFrame:
    """Drain a stream of timings; what `metrics.histograms` gives for all of its rows."""
    folder = folder or f"{shared_folder(timings.sparkSession)}/timings-{uuid.uuid4().hex}"
    published = drained(reservoirs(timings, reservoir, shards), folder)
    last = published.groupBy("name", "shard").agg(F.max_by(F.struct("late", "count", "max"), "batch").alias("x")).select("name", "x.*")
    whole = last.groupBy("name").agg(F.sum("count").alias("count"), F.max("max").alias("max"))
    return snapshot(whole, last_values(last.select("name", F.inline("late")), ("name",), F.col("ms"), "seq", reservoir), ("name",))
