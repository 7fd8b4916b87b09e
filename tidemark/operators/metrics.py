"""Run metrics: histograms over a bounded window, counters and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import RESERVOIR
from tidemark.functions.scoring import round_to


def nearest_rank(values: Column, share: float) -> Column:
    """The nearest-rank percentile of a sorted array."""
    return F.element_at(values, F.greatest(F.lit(1), F.ceil(F.size(values) * share).cast("int")))


def histograms(timings: DataFrame, keys: tuple[str, ...] = ("name",), value: str = "ms", order: str = "seq", reservoir: int = RESERVOIR) -> DataFrame:
    """keys, count, p50, p95, mean, max: finite values of at least 0; count and max over all, the rest over the last `reservoir`."""
    v = F.col(value).cast("double")
    sound = timings.where(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v != float("inf")))
    whole = sound.groupBy(*keys).agg(F.count("*").alias("count"), F.max(v).alias("max"))
    return snapshot(whole, last_values(sound, keys, v, order, reservoir), keys)


def last_values(rows: DataFrame, keys: tuple[str, ...], value: Column, order: str, reservoir: int) -> DataFrame:
    """keys, _v (the last values, sorted), mean (of them)."""
    late = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_n") <= reservoir)
    return late.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_v"), F.avg(value).alias("mean"))


def snapshot(whole: DataFrame, late: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Histograms from counts and highest values of all rows and from the last values."""
    return whole.join(late, list(keys)).select(
        *keys,
        "count",
        round_to(nearest_rank(F.col("_v"), 0.5), 2).alias("p50"),
        round_to(nearest_rank(F.col("_v"), 0.95), 2).alias("p95"),
        round_to(F.col("mean"), 2).alias("mean"),
        round_to(F.col("max"), 2).alias("max"),
    )


def counters(counts: DataFrame, key: str = "scan_id") -> DataFrame:
    """key, counters: map of sums by name."""
    summed = counts.groupBy(key, "name").agg(F.sum("n").alias("n"))
    return summed.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("counters"))


def throughput(timings: DataFrame, key: str, name: str, elapsed_s: Column) -> DataFrame:
    """key, per_second: timings of a name per elapsed second, 0 without time."""
    rows = timings.groupBy(key).agg(F.count_if(F.col("name") == name).alias("n"), elapsed_s.alias("s"))
    return rows.select(key, F.when(F.col("s") > 0, F.col("n") / F.col("s")).otherwise(F.lit(0.0)).alias("per_second"))


def long_tasks(tasks: DataFrame, key: str = "scan_id", least_ms: float = 50.0) -> DataFrame:
    return tasks.where(F.col("ms") >= least_ms).groupBy(key).agg(F.count("*").alias("tasks"), F.max("ms").alias("worst_ms"))


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last row per key: what remains of a run of updates that replace each other."""
    whole = F.struct(*[F.col(c) for c in events.columns])
    return events.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.col(order)).alias("_row")).select("_row.*")


def frames_per_second(events: DataFrame, time_col: str = "ts") -> DataFrame:
    """second, fps: events per second of the clock."""
    return events.groupBy(F.window(time_col, "1 second").alias("w")).agg(F.count("*").alias("fps")).select(F.col("w.start").alias("second"), "fps")
