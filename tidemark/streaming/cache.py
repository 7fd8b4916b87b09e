"""The perceptual cache as streaming state: the last scored hashes of every video survive between micro-batches.

Within a micro-batch a video's frames are taken in arrival order. The state of a video is at most `capacity` pairs of a
hash and a score, whatever the length of the stream. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.constants import CACHE_FRAMES, NO_HASH
from tidemark.operators.near import Cache

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "video_id long, arrival long, score double, inherited boolean"


class CacheProcessor(StatefulProcessor):
    def __init__(self, threshold: int, capacity: int):
        self.threshold, self.capacity = threshold, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "bits string, score double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cache = Cache(self.threshold, self.capacity, ((int(h, 16), s) for h, s in self.held.get()))
        out = []
        for r in pd.concat(list(rows)).sort_values("arrival").itertuples():
            out.append((key[0], r.arrival, *cache.judge(int(r.hash or NO_HASH, 16), r.score)))
        self.held.put([(f"{h:016x}", s) for h, s in cache.held])
        yield pd.DataFrame(out, columns=["video_id", "arrival", "score", "inherited"])

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def cached_scores(stream: DataFrame, threshold: int = 6, capacity: int = CACHE_FRAMES) -> DataFrame:
    """The streaming form of the batch operator: stream (video_id, arrival, hash, score), arrivals rising from batch to batch."""
    return stream.groupBy("video_id").transformWithStateInPandas(statefulProcessor=CacheProcessor(threshold, capacity), outputStructType=OUT, outputMode="Update", timeMode="None")
