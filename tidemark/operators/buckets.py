"""Time buckets, so that one video's frames use many tasks.

What needs a video's frames in order takes two levels: frames meet by (video, bucket), which a video of a third of all frames
has as many of as its length asks for, and are ordered there; what must cross the edges of buckets is one row per bucket,
over which windows by video run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A minute: 1,500 frames of a video at 25 frames a second.
BUCKET_MS = 60_000
#: The column that says to which bucket a frame belongs.
BUCKET = "bucket"


def bucket_of(ts: Column, width: int = BUCKET_MS) -> Column:
    return F.floor(ts / width).cast("long")


def bucketed(frames: DataFrame, ts: str = "ts_ms", width: int = BUCKET_MS) -> DataFrame:
    """frames with their bucket; those that are dealt by it already keep their column and their place."""
    return frames if BUCKET in frames.columns else frames.withColumn(BUCKET, bucket_of(F.col(ts), width))
