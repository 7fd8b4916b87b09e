"""How scans end: what stops them, when they have a first verdict, and what becomes of them.

A scan is the rows of its log in order, one per request. Before each request, and once more after the last, these are asked in
order: is it cancelled, are as many frames recorded as its budget allows, is its time spent. The first that holds ends it;
requests from there on were never made. With nothing left to ask it is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import Budget


def recorded(log: DataFrame) -> DataFrame:
    """log (video_id, step, ts_ms, failed) with recorded and duplicate: of the deliveries of one time the first is recorded, the others are duplicates."""
    again = F.row_number().over(Window.partitionBy("video_id", "ts_ms", "failed").orderBy("step")) > 1
    return log.withColumn("duplicate", ~F.col("failed") & again).withColumn("recorded", ~F.col("failed") & ~F.col("duplicate"))


def outcomes(log: DataFrame, budget: Budget) -> DataFrame:
    """video_id, stop_reason, outcome, sampled, failed, duplicates, elapsed_ms, first_verdict_ms of every scan.

    log: video_id, step, survey (a request of the survey), failed, duplicate, recorded, elapsed_ms (when it was answered) and cancelled (the
    scan was, before this request). outcome: the stop reason, or no-frames where none was recorded in a scan that was not
    cancelled. First verdict: when the last survey request is taken, or the next one if nothing is recorded by then; of a scan that
    ends before, its end; null without a frame.
    """
    order, whole = Window.partitionBy("video_id").orderBy("step"), Window.partitionBy("video_id")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c: F.col(c).cast("long")
    run = log.withColumns(
        {
            "_frames": F.coalesce(F.sum(count("recorded")).over(before), F.lit(0)),
            "_spent": F.coalesce(F.max("elapsed_ms").over(before), F.lit(0)),
            "_surveyed": F.sum(count("survey")).over(so_far) == F.sum(count("survey")).over(whole),
        }
    )
    full, late = lambda frames: frames >= budget.max_frames, lambda spent: spent > budget.max_ms
    reason = F.when(F.col("cancelled"), "cancelled").when(full(F.col("_frames")), "frame-budget").when(late(F.col("_spent")), "time-budget")
    ended = run.withColumn("_reason", reason).withColumn("_end", F.min(F.when(F.col("_reason").isNotNull(), F.col("step"))).over(whole))
    made = F.col("_end").isNull() | (F.col("step") < F.col("_end"))
    rows = ended.groupBy("video_id").agg(
        F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.col("step"))).alias("_reason"),
        F.count_if(made & F.col("recorded")).alias("sampled"),
        F.count_if(made & F.col("failed")).alias("failed"),
        F.count_if(made & F.col("duplicate")).alias("duplicates"),
        F.coalesce(F.max(F.when(made, F.col("elapsed_ms"))), F.lit(0)).cast("long").alias("elapsed_ms"),
        F.min(F.when(made & F.col("_surveyed") & (F.col("_frames") > 0), F.col("_spent"))).alias("_first"),
    )
    stop = F.coalesce("_reason", F.when(full(F.col("sampled")), "frame-budget").when(late(F.col("elapsed_ms")), "time-budget").otherwise("complete"))
    told = rows.withColumn("stop_reason", stop).withColumn("outcome", F.when((F.col("sampled") == 0) & (F.col("stop_reason") != "cancelled"), "no-frames").otherwise(F.col("stop_reason")))
    first = F.coalesce("_first", F.when(F.col("sampled") > 0, F.col("elapsed_ms"))).cast("long")
    return told.select("video_id", "stop_reason", "outcome", "sampled", "failed", "duplicates", "elapsed_ms", first.alias("first_verdict_ms"))
