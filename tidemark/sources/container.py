"""Container indexes: files sniffed by Spark's binary source, and per-sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.device import accepts_mime, looks_like_iso_bmff, source_kind
from tidemark.functions.scoring import half_up


def sniffed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, iso_bmff and the frame source of local files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    iso = looks_like_iso_bmff(F.col("content"))
    kind = source_kind(F.lit(True), F.col("length"), F.lit(True), iso)
    return files.select("path", "length", iso.alias("iso_bmff"), kind["kind"].alias("kind"), kind["reason"].alias("reason"))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Model manifests from JSON lines: rows without labels or with a class index out of range are left out; defaults filled in."""
    schema = "labels array<string>, violenceIndex int, inputSize int, mean array<double>, std array<double>"
    half = F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5))
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("m")).select("m.*")
    sound = rows.where((F.size("labels") > 0) & F.col("violenceIndex").between(0, F.size("labels") - 1))
    return sound.select("labels", "violenceIndex", F.coalesce("inputSize", F.lit(224)).alias("inputSize"), F.coalesce("mean", half).alias("mean"), F.coalesce("std", half).alias("std"))


def ingestible(files: DataFrame) -> DataFrame:
    """Files (mime) that may hold video."""
    return files.where(accepts_mime(F.col("mime")))


def upper_median(x: str) -> F.Column:
    """The element in the middle of the sorted values, the upper one of two."""
    ordered = F.array_sort(F.collect_list(x))
    return F.try_element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def indexed(samples: DataFrame) -> DataFrame:
    """samples (video_id, ts_ms, duration_ms, is_sync) with is_sync holding for the first sample where none has it."""
    whole = Window.partitionBy("video_id")
    first = F.row_number().over(whole.orderBy("ts_ms")) == 1
    some = F.max(F.col("is_sync").cast("int")).over(whole) == 1
    return samples.withColumn("is_sync", F.when(some, F.col("is_sync")).otherwise(first))


def container_stats(samples: DataFrame) -> DataFrame:
    """Per video: duration_ms from the last sample, median frame_ms (40 if unknown), median keyframe_gap_ms, keyframes."""
    order = Window.partitionBy("video_id").orderBy("ts_ms")
    rows = indexed(samples)
    last = F.max(F.struct("ts_ms", "duration_ms"))
    frames = rows.groupBy("video_id").agg(
        F.greatest(F.lit(1).cast("long"), half_up((last["ts_ms"] + last["duration_ms"]).cast("double"))).alias("duration_ms"),
        F.count_if("is_sync").alias("keyframes"),
    )
    shown = rows.where("duration_ms > 0").groupBy("video_id").agg(upper_median("duration_ms").alias("frame_ms"))
    gaps = rows.where("is_sync").withColumn("gap", F.col("ts_ms") - F.lag("ts_ms").over(order)).where("gap > 0")
    gaps = gaps.groupBy("video_id").agg(upper_median("gap").alias("keyframe_gap_ms"))
    joined = frames.join(shown, "video_id", "left").join(gaps, "video_id", "left")
    return joined.withColumn("frame_ms", F.coalesce(F.col("frame_ms").cast("double"), F.lit(40.0)))
