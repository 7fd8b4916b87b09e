"""Texts for reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scoring import half_up


def timestamp(ms: Column) -> Column:
    """h:mm:ss, m:ss or 0:ss.s; negative or infinite times are 0:00.

    Tenths are rounded from the double itself, ties to even, as in C; format_string would round its shortest decimals, ties up.
    """
    total = ms / 1000.0
    hours = F.floor(total / 3600).cast("long")
    minutes = F.floor((total - hours * 3600) / 60).cast("long")
    seconds = total - F.floor(total / 60) * 60
    whole = F.lpad(F.floor(seconds).cast("string"), 2, "0")
    fine = F.format_number(seconds, 1)
    return (
        F.when(ms.isNull() | F.isnan(ms.cast("double")) | (F.abs(ms.cast("double")) == float("inf")) | (ms < 0), "0:00")
        .when(hours > 0, F.concat_ws(":", hours, F.lpad(minutes.cast("string"), 2, "0"), whole))
        .when(minutes > 0, F.concat_ws(":", minutes, whole))
        .otherwise(F.concat(F.lit("0:"), fine))
    )


def byte_size(n: Column) -> Column:
    exponent = F.least(F.lit(3), F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0)))).cast("int")
    value = n / F.pow(F.lit(1024.0), exponent)
    unit = F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), F.greatest(exponent, F.lit(0)) + 1)
    number = F.when((value >= 100) | (exponent == 0), F.format_string("%.0f", value)).otherwise(F.format_string("%.1f", value))
    return F.when(n <= 0, "0 B").otherwise(F.concat_ws(" ", number, unit))


def duration(ms: Column) -> Column:
    x = ms.cast("double")
    return (
        F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "-")
        .when(x < 1, F.format_string("%.2f ms", x))
        .when(x < 10, F.format_string("%.1f ms", x))
        .when(x < 1000, F.format_string("%.0f ms", x))
        .otherwise(F.format_string("%.2f s", x / 1000.0))
    )


def percent(x: Column) -> Column:
    return F.concat(half_up(x * 100).cast("string"), F.lit("%"))


def timeline_box(start_ms: Column, end_ms: Column, duration_ms: Column) -> Column:
    """struct<left_pct, width_pct> of a segment on a timeline."""
    left = F.least(F.lit(100.0), F.greatest(F.lit(0.0), start_ms / duration_ms * 100))
    return F.struct(left.alias("left_pct"), F.greatest(F.lit(0.6), (end_ms - start_ms) / duration_ms * 100).alias("width_pct"))


def timeline_axis(duration_ms: Column) -> Column:
    """array<struct<share, label>>: where a timeline's axis is marked, from its start to its end."""
    marks = [F.struct(F.lit(share).alias("share"), timestamp(duration_ms * share).alias("label")) for share in (0.0, 0.25, 0.5, 0.75, 1.0)]
    return F.array(*marks)
