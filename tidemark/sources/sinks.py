"""What a scan publishes: verdicts, tagged events and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.formats import duration, percent
from tidemark.operators.temporal import verdict_json

PHASES = ("loading", "analysing", "survey", "refine", "done", "cancelled")


def write_verdicts(rows: DataFrame, path: str) -> None:
    """A line per video: its id, a tab, and a JSON object of exactly two keys."""
    rows.select(F.concat_ws("\t", F.col("video_id").cast("string"), verdict_json(rows)).alias("value")).write.text(path)


def event(type_: str, /, **payload: Column) -> Column:
    """A tagged event: its type and only the payload that belongs to it."""
    fields = ("phase", "message", "kind", "result")
    return F.struct(F.lit(type_).alias("type"), *[payload.get(f, F.lit(None)).cast("string").alias(f) for f in fields])


def thumbnail(frame_threshold: float, picture: str = "thumbnail") -> Column:
    """Pictures are kept of flagged frames only."""
    return F.when(F.col("score") >= frame_threshold, F.col(picture))


def report_rows(rows: DataFrame) -> DataFrame:
    """Verdict rows (with elapsed_ms) as lines of a Markdown table."""
    yes = F.when(F.col("contains_inappropriate_content"), "flagged").otherwise("clean")
    cells = (F.col("video_id").cast("string"), yes, F.format_string("%.2f", F.col("confidence")), percent(F.col("coverage")), duration(F.col("elapsed_ms")))
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
