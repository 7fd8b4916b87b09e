"""Two levels: what needs order takes (video, bucket) first."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.constants import POLICIES
from tidemark.operators import buckets, lookups, temporal
from tidemark.sources import frames as sources

BALANCED = POLICIES["balanced"]
SCHEMA = "video_id long, ts_ms long, score double, duration_ms long"


def hot(spark, share=3000, others=40):
    """One video has a third of all frames."""
    r = random.Random(1)
    rows = [(0, t, r.random(), 40 * share) for t in range(0, 40 * share, 40)]
    rows += [(v, t, r.random(), 40 * share) for v in range(1, others) for t in r.sample(range(40 * share), 2 * share // others)]
    return spark.createDataFrame(rows, SCHEMA)


def spans(rows, gap=2000, pad=600):
    out = []
    for t, s, d in sorted(rows):
        if s < BALANCED.frame_threshold:
            continue
        if out and t - out[-1][1] <= gap:
            out[-1][1] = t
            if s > out[-1][2]:
                out[-1][2:4] = [s, t]
        else:
            out.append([t, t, s, t, d])
    return [(max(0, a - pad), min(b + pad, d), s, t) for a, b, s, t, d in out]


def test_coverage_and_segments_of_a_hot_video(spark):
    table = hot(spark)
    by_video = {}
    for v, t, s, d in map(tuple, table.collect()):
        by_video.setdefault(v, []).append((t, s, d))
    found = {}
    for r in temporal.segments(table, BALANCED).orderBy("video_id", "segment").collect():
        found.setdefault(r.video_id, []).append((r.start_ms, r.end_ms, r.peak_score, r.peak_ts_ms))
    assert found == {v: spans(rows) for v, rows in by_video.items()}
    covered = {r.video_id: r.coverage for r in temporal.coverage(table).collect()}
    for v, rows in by_video.items():
        times = sorted(t for t, _, _ in rows)
        held = sum(min(4000, b - a) for a, b in zip(times, times[1:], strict=False)) + min(2000, times[0]) + min(2000, rows[0][2] - times[-1])
        assert covered[v] == pytest.approx(min(1, held / rows[0][2]))


def test_rows_of_a_hot_video_use_many_tasks(spark):
    """Dealt by video and bucket, no task has more than about twice the median; by video, one has a third of all rows."""
    table = buckets.bucketed(hot(spark, 12_000), width=4000)
    sizes = lambda *keys: sorted(r["n"] for r in table.repartition(8, *keys).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
    two, one = sizes("video_id", buckets.BUCKET), sizes("video_id")
    assert two[-1] <= 2 * two[len(two) // 2]
    assert one[-1] >= 12_000


def test_no_plan_orders_frames_by_video_alone(spark):
    """Windows over frames are by (video, bucket); by video only one row per bucket or run is ordered."""
    table = hot(spark, 300)
    for made in (temporal.coverage(table), temporal.segments(table, BALANCED)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.split("\n") if "hashpartitioning" in x]
        assert len(exchanges) == 2
        assert "bucket" in exchanges[-1] and "bucket" not in exchanges[0].split("hashpartitioning")[1]


def test_dealt_frames_are_shuffled_once(spark, tmp_path):
    """Frames that are dealt by bucket already keep their place: besides them only parts move."""
    r = random.Random(3)
    rows = [(r.randrange(9), k, float(r.randrange(400)), "view") for k in range(500)]
    table = spark.createDataFrame(rows, "user_id long, event_id long, value double, event_type string")
    table.withColumn("ts", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("event_id").cast("decimal(18,6)") * 13))).write.parquet(str(tmp_path / "events.parquet"))
    plan = temporal.coverage(sources.bucketed_frames(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 2


@pytest.mark.parametrize("width", [10, 1000, 60_000])
def test_as_of_across_buckets(spark, width):
    r = random.Random(width)
    rights = {k: sorted(r.sample(range(5000), n)) for k, n in ((1, 40), (2, 1), (3, 7))}
    lefts = [(k, r.randrange(-50, 5200)) for k in (1, 2, 3, 4) for _ in range(60)] + [(None, 5), (1, None)]
    left = spark.createDataFrame(lefts, "k long, t long")
    right = spark.createDataFrame([(k, t, f"r{t}") for k, ts in rights.items() for t in ts] + [(None, 3, "none"), (1, None, "never")], "k long, r long, what string")
    got = sorted(map(tuple, lookups.as_of(left, right, "k", "t", "r", "out", also=("what",), width=width).collect()), key=str)
    rights[None] = [3]

    def want(k, t):
        known = rights.get(k, [])
        at = max((x for x in known if t is not None and x <= t), default=known[0] if known else None)
        return k, t, at, None if at is None else "none" if k is None else f"r{at}"

    assert got == sorted((want(k, t) for k, t in lefts), key=str)
