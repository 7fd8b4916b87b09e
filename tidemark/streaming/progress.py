"""Progressively refined verdicts over a stream of frame deliveries.

Frames of a video arrive in any order and none is ever late, so there is no watermark: the state of a video is its
timeline (`timeline`), of which a trigger reads and writes the time buckets that its frames fall into and the few nodes
above them. Nothing bounds a timeline but the frames that a source delivers; each of them is held once. Every trigger publishes
the verdicts of the videos that changed (update mode).
Micro-batches are written under their number to a folder that all executors share; a later one replaces an earlier one
of the same video, so a batch that is written again after a failure changes nothing. Needs the RocksDB state store.
"""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.constants import MERGE_GAP_MS, PAD_MS, Policy
from tidemark.operators.buckets import BUCKET, bucketed
from tidemark.operators.metrics import latest
from tidemark.operators.temporal import confidence, joined_runs, positive, verdict_json, verdicts
from tidemark.shared import shared_folder
from tidemark.sources.frames import first_delivered
from tidemark.sources.sinks import event
from tidemark.streaming.cache import with_state_store
from tidemark.streaming.timeline import RunsProcessor, VerdictProcessor

DELIVERY = ("ts_ms", "arrival", "score", "duration_ms")


def _keyed(deliveries: DataFrame, *keys: str) -> tuple[DataFrame, str]:
    """What the processors take, and how the keys are declared in what they give."""
    kinds = {"ts_ms": "long", "arrival": "long", "score": "double", "duration_ms": "long"}
    rows = deliveries.select(*keys, *[F.col(c).cast(kinds[c]).alias(c) for c in DELIVERY])
    return rows, ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)


SNAPSHOT = ("video_id", "n_frames", "contains_inappropriate_content", "confidence")


def _judged(stream: DataFrame, policy: Policy) -> DataFrame:
    """What verdicts rest on and verdicts, with frames_before (the batch) and duration_ms, of the videos that changed."""
    rows, key = _keyed(stream, "video_id")
    found = rows.groupBy("video_id").transformWithState(VerdictProcessor(policy), f"{key}, {VerdictProcessor.OUT}", "Update", "None")
    return found.withColumn("contains_inappropriate_content", positive(policy)).withColumn("confidence", confidence(policy))


def snapshots(deliveries: DataFrame, policy: Policy) -> DataFrame:
    """video_id, n_frames, verdict and confidence from deliveries: of a stream by its state, of a table by the batch operators."""
    found = _judged(deliveries, policy) if deliveries.isStreaming else verdicts(first_delivered(deliveries), policy)
    return found.select(*SNAPSHOT)


def _told(rows: DataFrame, survey_frames: int | None) -> DataFrame:
    """The events of judged rows: progress; with the frames of a survey, also what a video is (meta) and the phase that it comes to."""
    surveyed = F.col("n_frames") >= survey_frames if survey_frames else F.lit(False)
    phase = F.when(surveyed, "refine").otherwise("survey")
    events = [event("progress", phase=phase, result=verdict_json(rows))]
    if survey_frames:
        fresh, comes = F.col("frames_before") == 0, surveyed & (F.col("frames_before") < survey_frames)
        events += [F.when(fresh, event("meta", result=F.to_json(F.struct("duration_ms")))), F.when(fresh, event("phase", phase=F.lit("survey"))), F.when(comes, event("phase", phase=F.lit("refine")))]
    return rows.select("video_id", F.explode(F.array_compact(F.array(*events))).alias("event"))


def start(stream: DataFrame, policy: Policy, folder: str, every: str | None = None, survey_frames: int | None = None):
    """Publish verdicts under folder: every so often ('100 milliseconds'), or until the stream is drained. stop() cancels; a new start goes on.

    Every micro-batch also writes its events: 'progress' per video that changed, with the verdict as its result. With survey_frames,
    the events before the first batch say that the model is ready, and videos tell their 'meta' and the 'phase' that they come to.
    """
    spark = stream.sparkSession
    with_state_store(spark)

    def publish(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/published/number={number}")
        stored = spark.read.parquet(f"{folder}/published/number={number}")
        _told(stored, survey_frames).select(F.lit(number).cast("long").alias("batch"), "video_id", "event.*").write.mode("overwrite").parquet(f"{folder}/events/part={number:09d}")

    if survey_frames:
        opening = F.explode(F.array(event("phase", phase=F.lit("loading")), event("model-ready", message=F.lit(policy.id)))).alias("event")
        first = spark.range(1).select(F.lit(-1).cast("long").alias("batch"), F.lit(None).cast("long").alias("video_id"), opening)
        first.select("batch", "video_id", "event.*").write.mode("overwrite").parquet(f"{folder}/events/part=first")
    columns = (*SNAPSHOT, "frames_before", "duration_ms")
    writer = _judged(stream, policy).select(*columns).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(publish)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def finish(spark: SparkSession, query, folder: str) -> None:
    """Wait for a started stream and write its last event: 'done', or 'error' with its kind and message, which is raised again."""
    try:
        query.awaitTermination()
        last, failure = event("done", phase=F.lit("done")), None
    except StreamingQueryException as e:
        failure = e
        last = event("error", kind=F.lit("stream"), message=F.lit(str(e)[:2000]))
    one = spark.range(1).select(F.lit(None).cast("long").alias("video_id"), last.alias("event"))
    one.select(F.lit(2**62).alias("batch"), "video_id", "event.*").write.mode("overwrite").parquet(f"{folder}/events/part=last")
    if failure is not None:
        raise failure


def events(spark: SparkSession, folder: str) -> DataFrame:
    """batch, video_id, type, phase, message, kind, result of all events; the one that ends the stream has the highest batch."""
    return spark.read.parquet(f"{folder}/events").drop("part")


def published(spark: SparkSession, folder: str) -> DataFrame:
    """The last verdict of every video."""
    return latest(spark.read.parquet(f"{folder}/published").select(*SNAPSHOT, "batch"), "video_id", "batch").drop("batch")


def run(spark: SparkSession, stream: DataFrame, policy: Policy, folder: str | None = None) -> DataFrame:
    """Drain a stream of deliveries; the last published verdict of every video."""
    folder = folder or f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    finish(spark, start(stream, policy, folder), folder)
    return published(spark, folder)


def flagged_runs(deliveries: DataFrame, policy: Policy, merge_gap: int = MERGE_GAP_MS) -> DataFrame:
    """video_id, bucket, runs: the runs of flagged frames of every time bucket that changed, from a stream in any order, without a watermark.

    The state is a bucket's frames. A late frame joins runs of its bucket here, and spans across buckets where they are read.
    """
    rows, keys = _keyed(bucketed(deliveries), "video_id", BUCKET)
    return rows.groupBy("video_id", BUCKET).transformWithState(RunsProcessor(policy.frame_threshold, merge_gap), f"{keys}, {RunsProcessor.OUT}", "Update", "None")


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Drain a stream in update mode to folder, a table per micro-batch; all its rows, with the number of their batch."""
    with_state_store(stream.sparkSession)
    publish = lambda rows, number: rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/published/number={number}")
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(publish).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(f"{_ddl(stream)}, batch int").parquet(f"{folder}/published/number=*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def segments(stream: DataFrame, policy: Policy, folder: str | None = None, merge_gap: int = MERGE_GAP_MS, pad: int = PAD_MS) -> DataFrame:
    """The restricted spans of a drained stream: what `temporal.segments` gives for its first deliveries."""
    folder = folder or f"{shared_folder(stream.sparkSession)}/spans-{uuid.uuid4().hex}"
    published = drained(flagged_runs(stream, policy, merge_gap), folder)
    last = published.groupBy("video_id", BUCKET).agg(F.max_by("runs", "batch").alias("runs"))
    runs = last.select("video_id", F.inline("runs")).select("video_id", "first", "last", "d", F.struct(F.col("peak_score").alias("score"), (-F.col("peak_ts_ms")).alias("t")).alias("p"))
    return joined_runs(runs, merge_gap, pad)


def observed(frames: DataFrame, name: str = "frames") -> tuple[DataFrame, Observation]:
    """frames with run metrics that cost no pass of their own: rows, flagged share and highest score once an action has run."""
    seen = Observation(name)
    return frames.observe(seen, F.count("*").alias("rows"), F.avg((F.col("score") >= 0.5).cast("double")).alias("high_share"), F.max("score").alias("max_score")), seen


def sessions(deliveries: DataFrame, time_col: str, gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """Flagged spans as session windows, for sinks that can only append: a span is published once it can't grow any more."""
    return deliveries.withWatermark(time_col, late).groupBy("video_id", F.session_window(time_col, gap).alias("span")).agg(F.count("*").alias("frames"), F.max("score").alias("peak_score"))
