"""Relations of the screening model derived from the given tables.

frames: one row per scored frame of a video: video_id, ts_ms, score, arrival, duration_ms; unique in (video_id, ts_ms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import hashing, scoring
from tidemark.operators import buckets

DURATION_MS = 259_200
EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_delivered(frames: DataFrame, keys: tuple[str, ...] = ("video_id", "ts_ms"), order: str = "arrival") -> DataFrame:
    """One row per delivered time: the first to arrive."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return frames.withColumn("_n", rank).where("_n = 1").drop("_n")


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_deliveries(table(spark, sf_dir, "events"))


def as_deliveries(events: DataFrame) -> DataFrame:
    """events as deliveries: a user is a video, ten seconds are a millisecond, value / 400 is the score."""
    micros = F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)")
    return events.select(
        F.col("user_id").alias("video_id"),
        F.floor(micros / F.lit(1e7)).cast("long").alias("ts_ms"),
        F.least(F.lit(1.0), F.col("value") / F.lit(400.0)).alias("score"),
        F.col("event_id").alias("arrival"),
        F.col("event_type").alias("kind"),
        F.lit(DURATION_MS).cast("long").alias("duration_ms"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by video at once: what follows per (video, time) and per video then needs no other shuffle."""
    return first_delivered(deliveries(spark, sf_dir).repartition(F.col("video_id")))


def bucketed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with their time bucket, dealt by video and bucket: for what takes a video's frames in two levels."""
    rows = buckets.bucketed(deliveries(spark, sf_dir)).repartition(F.col("video_id"), F.col(buckets.BUCKET))
    return first_delivered(rows, ("video_id", buckets.BUCKET, "ts_ms"))


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """events as a stream; files_per_trigger holds the source back to so many files per micro-batch."""
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/events.parquet*")


def stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """deliveries as a stream."""
    return as_deliveries(event_stream(spark, sf_dir, files_per_trigger))


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, kf_ms: the times of signup events."""
    return deliveries(spark, sf_dir).where("kind = 'signup'").select("video_id", F.col("ts_ms").alias("kf_ms")).distinct()


def class_logits(values: Column) -> Column:
    """Five class logits of an array of any length: the sums of every fifth component."""
    return F.transform(F.array(*[F.lit(k) for k in range(5)]), lambda k: F.aggregate(F.filter(values, lambda x, i: i % 5 == k), F.lit(0.0), lambda a, x: a + x.cast("double")))


def class_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, logits of whole embeddings, and their softmax as class scores."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), class_logits(F.col("embedding")).alias("logits"))
    return rows.withColumn("probabilities", scoring.softmax(F.col("logits")))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id and the dHash of an embedding seen as an 8 x 8 luma image."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), hashing.dhash(F.col("embedding"), 8, 8).alias("hash"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, categories: labelled documents are screened for sexual (1 - quality) and violence (toxic), others for nothing."""
    documents, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    joined = documents.select("doc_id", "source").join(labels, "doc_id", "left")
    scores = F.create_map(F.lit("sexual"), (1 - F.col("quality")).cast("double"), F.lit("violence"), F.col("toxic").cast("double"))
    found = F.when(F.col("quality").isNotNull(), F.map_filter(scores, lambda k, v: v.isNotNull())).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    return joined.select("doc_id", "source", found.alias("categories"))
