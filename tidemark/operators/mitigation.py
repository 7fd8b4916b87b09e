"""What a player shows of a video, from its verdict and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import TRUSTED_COVERAGE
from tidemark.operators.lookups import in_spans

SCANNING = ("loading", "analysing", "survey", "refine")


def is_scanning(phase: Column) -> Column:
    return F.coalesce(phase.isin(*SCANNING), F.lit(False))


def obscured(state: DataFrame) -> DataFrame:
    """state (mode, phase, finalized, flagged, segments, coverage, in_span, revealing, acknowledged) with trustworthy, blur, block, pregate, obscured.

    Spans are trusted to say where to blur only once the scan is final and covers the video; before that all is blurred.
    """
    trustworthy = F.col("finalized") & (F.col("segments") > 0) & (F.col("coverage") >= TRUSTED_COVERAGE)
    made = state.withColumn("trustworthy", trustworthy)
    blur = (F.col("mode") == "blur") & F.col("flagged") & ~F.col("revealing") & (~F.col("trustworthy") | F.col("in_span"))
    return (
        made.withColumn("blur", blur)
        .withColumn("block", (F.col("mode") == "block") & F.col("flagged") & ~F.col("acknowledged"))
        .withColumn("pregate", (F.col("mode") == "pregate") & ~F.col("finalized") & (F.col("phase") != "idle"))
        .withColumn("obscured", F.col("blur") | F.col("block") | F.col("pregate"))
    )


def restricted_points(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Playhead positions (video_id, ts_ms) that fall into a restricted span."""
    return in_spans(points, spans, "video_id", "ts_ms")
