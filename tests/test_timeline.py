"""A video's timeline as state: equal to the batch operators in any order, and a late frame touches few entries."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.constants import POLICIES
from tidemark.operators import temporal
from tidemark.streaming import progress
from tidemark.streaming.timeline import Timeline

BALANCED = POLICIES["balanced"]
SCHEMA = "video_id long, arrival long, ts_ms long, score double, duration_ms long"


class Counted(dict):
    """A store that counts what is read and written."""

    def __init__(self):
        super().__init__()
        self.reads = self.writes = 0

    def get(self, key):
        self.reads += 1
        return list(super().get(key, []))

    def put(self, key, value):
        self.writes += 1
        self[key] = value


def direct(frames, threshold, gap, duration, most):
    """n, best, coverage, independent of frames {ts: score}, by loops over all of them."""
    times = sorted(frames)
    held = sum(max(0, min(2000, (t - p) / 2 if k else t)) + max(0, min(2000, (n - t) / 2 if n is not None else duration - t)) for k, (p, t, n) in enumerate(zip([0, *times], times, [*times[1:], None], strict=False)))
    n, at = 0, None
    for t in times:
        if frames[t] >= threshold and (at is None or gap <= 0 or t - at >= gap):
            n, at = n + 1, t
    return len(times), sorted(frames.values(), reverse=True)[:3], min(1.0, held / duration), min(n, most)


@pytest.mark.parametrize(("width", "fan"), [(1000, 2), (5000, 4), (60_000, 64), (7, 3)])
def test_any_order_gives_what_loops_over_all_frames_give(width, fan):
    r = random.Random(width)
    for gap in (0, 400, 3000):
        stores, top, frames, arrived = (Counted(), Counted()), 0, {}, {}
        for _ in range(12):
            batch = [(r.choice([r.randrange(300), r.randrange(60_000), r.randrange(2_000_000)]), r.randrange(1000), r.random()) for _ in range(r.choice([1, 3, 40]))]
            line = Timeline(*stores, 0.55, top, width, fan)
            line.add(batch)
            top = line.top
            for t, a, s in batch:
                if t not in arrived or a < arrived[t]:
                    arrived[t], frames[t] = a, s
            want = direct(frames, 0.55, gap, 2_000_000, 3)
            assert (line.whole.n, line.whole.best, line.independent(gap, 3)) == (want[0], want[1], want[3])
            assert line.coverage(2_000_000) == pytest.approx(want[2], abs=1e-12)


def test_a_late_frame_touches_its_bucket_and_the_nodes_above():
    frames, nodes = Counted(), Counted()
    line = Timeline(frames, nodes, 0.55)
    line.add((t, t, (t // 1000 % 10) / 10) for t in range(0, 36_000_000, 1000))  # ten hours
    assert len(frames) == 600
    frames.reads = frames.writes = nodes.reads = nodes.writes = 0
    late = Timeline(frames, nodes, 0.55, line.top)
    late.add([(17_000_500, 1, 0.99)])
    assert (frames.reads, frames.writes, nodes.reads, nodes.writes) == (1, 1, 2, 2)
    assert late.independent(400, 3) == 3
    assert frames.reads <= 1 + 3 and nodes.reads <= 2 + 3 * 2
    assert late.whole.n == 36_001 and late.whole.best[0] == 0.99


def deliveries(r, videos, count):
    rows = []
    for v in range(videos):
        for a in range(count):
            t = r.choice([r.randrange(200_000), r.randrange(60) * 500])
            rows.append((v, 1000 * v + a, t, round(r.random() ** 2, 3), 200_000))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("policy", ["strict", "balanced", "permissive"])
def test_a_stream_in_any_order_equals_the_table(spark, tmp_path, policy):
    rows = deliveries(random.Random(len(policy)), 5, 60)
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    got = progress.run(spark, stream, POLICIES[policy], str(tmp_path / "out")).collect()
    want = progress.snapshots(spark.createDataFrame(rows, SCHEMA), POLICIES[policy]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 5


def test_spans_of_a_stream_in_any_order_equal_the_batch(spark, tmp_path):
    """Also a late frame that joins two spans, over the edge of a bucket, and a late delivery that takes one back."""
    rows = [*deliveries(random.Random(4), 4, 80), (9, 2, 59_000, 0.9, 200_000), (9, 3, 62_500, 0.9, 200_000), (9, 7, 100_000, 0.9, 200_000), (9, 8, 61_000, 0.8, 200_000), (9, 6, 100_000, 0.1, 200_000)]
    for k, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 : -2], rows[-2:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    got = sorted(map(tuple, progress.segments(stream, BALANCED, str(tmp_path / "out")).collect()))
    first = progress.first_delivered(spark.createDataFrame(rows, SCHEMA))
    assert got == sorted(map(tuple, temporal.segments(first, BALANCED).collect()))
    assert [x[2:] for x in got if x[0] == 9] == [(58_400, 63_100, 0.9, 59_000)]


def test_an_empty_stream_publishes_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert progress.segments(stream.where(F.col("score") > 2), BALANCED, str(tmp_path / "out")).count() == 0


def test_events_of_a_scan_from_loading_to_done(spark, tmp_path):
    rows = [(v, 10 * v + k, 1000 * k, 0.1, 60_000 * v) for v in (1, 2) for k in range(6 if v == 1 else 2)]
    for k in range(2):
        spark.createDataFrame(rows[k::2], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    progress.finish(spark, progress.start(stream, BALANCED, str(tmp_path / "out"), survey_frames=4), str(tmp_path / "out"))
    told = progress.events(spark, str(tmp_path / "out")).collect()
    assert [(r.type, r.phase or r.message) for r in told if r.batch == -1] == [("phase", "loading"), ("model-ready", "balanced")]
    own = lambda v: [(r.batch, r.type, r.phase, r.result) for r in sorted(told, key=lambda r: (r.batch, r.type, r.phase or "")) if r.video_id == v and r.type != "progress"]
    assert own(1) == [(0, "meta", None, '{"duration_ms":60000}'), (0, "phase", "survey", None), (1, "phase", "refine", None)]
    assert own(2) == [(0, "meta", None, '{"duration_ms":120000}'), (0, "phase", "survey", None)]
    assert [r.phase for r in sorted(told, key=lambda r: r.batch) if r.video_id == 1 and r.type == "progress"] == ["survey", "refine"]
    assert told and [r.type for r in told if r.batch > 10**6] == ["done"]
