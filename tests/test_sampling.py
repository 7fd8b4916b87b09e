import bisect
import heapq
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.constants import BUDGETS, POLICIES, Budget
from tidemark.operators import lookups, sampling, temporal
from tidemark.plans import registry

MEDIUM = BUDGETS["medium"]


def videos(spark, *durations):
    return spark.createDataFrame(list(enumerate(durations, 1)), "video_id long, duration_ms long")


def frames(spark, scores, video_id=1):
    return spark.createDataFrame([(video_id, t, float(s)) for t, s in scores], "video_id long, ts_ms long, score double")


@pytest.mark.parametrize(("duration", "n", "times"), [(16_000, 16, [500 + 1000 * k for k in range(16)]), (32_000, 8, [2000 + 4000 * k for k in range(8)]), (1200, 16, [150, 450, 750, 1050]), (80, 16, [40]), (7_200_000, 16, None)])
def test_survey_cells(spark, duration, n, times):
    got = [r.ts_ms for r in sampling.survey(videos(spark, duration), Budget(survey_frames=n)).orderBy("slot").collect()]
    assert got == times if times else len(got) == n


def test_survey_costs_the_same_at_any_duration_and_leaves_out_empty_videos(spark):
    made = sampling.survey(videos(spark, 60_000, 3_600_000, 36_000_000, 0), MEDIUM).groupBy("video_id").count().collect()
    assert {r.video_id: r["count"] for r in made} == {1: 16, 2: 16, 3: 16}


def best_first(duration, answers, rows, budget):
    """Halve the interval of the highest rank again and again, one at a time."""
    gap, times = budget.min_gap_ms, sorted(rows)

    def score_at(t):
        before = [x for x in times if x <= t]
        return rows[before[-1] if before else times[0]]

    seen = sorted(answers.items())
    ends = [(0, seen[0][1]), *seen, (duration, seen[-1][1])]
    rank = lambda a, b, x, y: math.floor((0.15 + max(x, y)) * math.log2(1 + (b - a) / gap) * 1e9 + 0.5) / 1e9
    waiting = [(a, b, x, y, 1) for (a, x), (b, y) in zip(ends, ends[1:], strict=False) if b - a >= 2 * gap]
    asked = []
    while waiting and len(asked) < budget.max_frames - len(answers):
        best = max(waiting, key=lambda i: (rank(*i[:4]), -i[4], -i[0]))
        waiting.remove(best)
        a, b, x, y, level = best
        middle = math.floor((a + b) / 2 + 0.5)
        s = score_at(middle)
        asked.append(middle)
        waiting += [i for i in ((a, middle, x, s, level + 1), (middle, b, s, y, level + 1)) if i[1] - i[0] >= 2 * gap]
    return asked, bool(waiting)


@pytest.mark.parametrize(("most", "gap"), [(10, 250), (25, 250), (40, 500), (200, 1000)])
def test_refinement_is_best_first(spark, most, gap):
    budget = Budget(survey_frames=6, max_frames=most, min_gap_ms=gap)
    rows = {t: (0.9 if abs(t - 20_000) < 6000 else 0.0) + (t * 7919 % 1000) / 1e5 for t in range(0, 60_000, 130)}
    table = frames(spark, rows.items())
    answers = sampling.served(sampling.survey(videos(spark, 60_000), budget), table)
    got = sampling.refine(videos(spark, 60_000), answers, table, budget).orderBy("place").collect()
    want, more = best_first(60_000, {r.ts_ms: r.score for r in answers.collect()}, rows, budget)
    assert {r.ts_ms for r in got} == set(want) and [r.place for r in got] == list(range(1, len(want) + 1))
    assert more == (len(got) == most - 6)
    hot = [t for t in want[:12] if abs(t - 20_000) <= 10_000]
    assert len(hot) > len(want[:12]) / 2 or most == 10


def test_refinement_ends_and_asks_nothing_twice(spark):
    budget = Budget(min_gap_ms=500)
    table = frames(spark, [(0, 0.9)])
    got = sampling.selected(videos(spark, 6000), table, budget).collect()
    assert len(got) < 40 and len({r.ts_ms for r in got}) == len(got)
    stats = sampling.request_stats(sampling.selected(videos(spark, 6000), table, budget)).first()
    assert (stats.frames, stats.duplicates, stats.surveyed + stats.refined) == (1, len(got) - 1, len(got))
    assert sampling.selected(videos(spark, 6000).where("false"), table, budget).count() == 0


def test_random_access(spark):
    """The sample itself, unless its keyframe is more than 24 samples away."""
    samples = [(1, t, t in (100, 2000)) for t in range(0, 4000, 10)] + [(2, t, False) for t in range(0, 400, 10)]
    table = spark.createDataFrame(samples, "video_id long, ts_ms long, is_sync boolean")
    asked = spark.createDataFrame([(1, -5), (1, 55), (1, 100), (1, 344), (1, 355), (1, 2244), (1, 2250), (1, 9999), (2, 245), (2, 399), (3, 1)], "video_id long, ts_ms long")
    got = {(r.video_id, r.ts_ms): (r.served_ms, r.on_keyframe) for r in lookups.fetch(asked, table).collect()}
    assert got == {
        (1, -5): (0, False), (1, 55): (50, False), (1, 100): (100, True), (1, 344): (340, False), (1, 355): (100, True), (1, 2244): (2240, False), (1, 2250): (2000, True), (1, 9999): (2000, True),
        (2, 245): (240, False), (2, 399): (0, True), (3, 1): (None, None),
    }


def sampled(duration, budget, keys, frames):
    """The whole of sampling, one request after the other: (ts, on_keyframe, level) in order. frames: {ts: score or None}."""
    gap, times, asked, taken = budget.min_gap_ms, sorted(frames), [], set()

    def answer(t):
        before = [x for x in times if x <= t]
        return frames[before[-1] if before else times[0]]

    def snap(at, tolerance):
        own = math.floor(at + 0.5)
        if not keys:
            return own
        low = min(sum(k < at for k in keys), len(keys) - 1)
        near = [(abs(k - at), k) for k in keys[max(0, low - 1) : low + 2] if abs(k - at) <= tolerance and k not in taken]
        return min(near)[1] if near else own

    n = max(1, min(budget.survey_frames, max(1, duration // gap), budget.max_frames))
    seen = []
    for k in range(n):
        at = (k + 0.5) * (duration / n)
        t = snap(at, duration / n / 2)
        if t not in taken:
            taken.add(t)
            asked.append((t, t != math.floor(at + 0.5), 0))
            if answer(t) is not None:
                seen.append((t, answer(t)))
    seen.sort()
    recorded = len(seen)
    ends = [(0, seen[0][1]), *seen, (duration, seen[-1][1])] if seen else []
    rank = lambda a, b, x, y: math.floor((0.15 + max(x, y)) * math.log2(1 + (b - a) / gap) * 1e9 + 0.5) / 1e9
    waiting = [(a, b, x, y, 1) for (a, x), (b, y) in zip(ends, ends[1:], strict=False)]
    while recorded < budget.max_frames:
        waiting = [w for w in waiting if w[1] - w[0] >= 2 * gap]
        if not waiting:
            break
        best = max(waiting, key=lambda i: (rank(*i[:4]), -i[4], -i[0]))
        waiting.remove(best)
        a, b, x, y, level = best
        t = snap((a + b) / 2, (b - a) / 4)
        if t in taken:
            t = math.floor((a + b) / 2 + 0.5)
            if t in taken:
                continue
        taken.add(t)
        s = answer(t)
        recorded += s is not None
        asked.append((t, t != math.floor((a + b) / 2 + 0.5), level))
        waiting += [(a, t, x, x if s is None else s, level + 1), (t, b, y if s is None else s, y, level + 1)]
    return asked


@pytest.mark.parametrize("seed", range(4))
def test_snapped_sampling_equals_one_request_after_the_other(spark, seed):
    """On random grids of keyframes, with frames that can't be read and videos whose survey fails in part or wholly."""
    r = random.Random(seed)
    budget = Budget(survey_frames=r.choice([4, 7]), max_frames=r.choice([15, 40]), min_gap_ms=r.choice([200, 500]))
    plain, keys, rows = [], {}, {}
    for v in range(12):
        duration = r.choice([900, 20_000, 33_331])
        plain.append((v, duration))
        keys[v] = sorted(r.sample(range(duration), r.choice([0, 1, 5, 60])))
        if v % 3 == 0:  # keyframes half-way between the cells' centres, which both want
            n = max(1, min(budget.survey_frames, duration // budget.min_gap_ms))
            keys[v] = [int(k * duration / n) for k in range(1, n) if k * duration % n == 0] or keys[v]
        lost = r.choice([0, 0.2, 0.6]) if v else 1
        rows[v] = {t: None if r.random() < lost else round(r.random(), 3) for t in r.sample(range(duration), 60)}
    table = spark.createDataFrame(plain, "video_id long, duration_ms long")
    frames = spark.createDataFrame([(v, t, s) for v in rows for t, s in rows[v].items()], "video_id long, ts_ms long, score double")
    kfs = spark.createDataFrame([(v, k) for v in keys for k in keys[v]], "video_id long, kf_ms long")
    got = {}
    for x in sampling.selected(table, frames, budget, kfs).orderBy("video_id", "level", "ts_ms").collect():
        got.setdefault(x.video_id, []).append((x.ts_ms, x.on_keyframe, x.level))
    for v, duration in plain:
        want = sampled(duration, budget, keys[v], rows[v])
        assert sorted(got[v]) == sorted(want), v


def test_requests_that_want_the_same_keyframe(spark):
    """The earlier one has it, and whoever follows depends on that; times that are asked for again are left out."""
    keys = [(1, k) for k in (1000, 2000, 2005, 9000)] + [(2, 500)]
    asked = [(1, 0, 1500.0), (1, 1, 2100.0), (1, 2, 2200.0), (1, 3, 2300.0), (1, 4, 8999.6), (1, 5, 9000.4), (2, 0, 400.0), (2, 1, 600.0), (2, 2, 600.2), (3, 0, 7.5), (2, 3, 4000.0)]
    rows = spark.createDataFrame([(v, s, t, 600.0) for v, s, t in asked], "video_id long, slot long, at double, tolerance double")
    got = {(r.video_id, r.slot): (r.ts_ms, r.on_keyframe) for r in lookups.snapped(rows, spark.createDataFrame(keys, "video_id long, kf_ms long")).collect()}
    assert got == {(1, 0): (1000, True), (1, 1): (2005, True), (1, 2): (2200, False), (1, 3): (2300, False), (1, 4): (9000, False), (2, 0): (500, True), (2, 1): (600, False), (2, 3): (4000, False), (3, 0): (8, False)}


def test_frames_are_shuffled_once(spark, tmp_path):
    """Survey and all levels are answered together: the plan has one exchange of frames' rows (the other is one row a bucket)."""
    frames(spark, [(t, 0.1) for t in range(0, 60_000, 50)]).write.parquet(str(tmp_path / "frames"))
    table = spark.read.parquet(str(tmp_path / "frames"))
    laid = spark.createDataFrame([(1, t) for t in range(0, 60_000, 250)], "video_id long, ts_ms long")
    plan = sampling.served(laid, table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2 and plan.count("hashpartitioning(video_id") == 3  # bucket ends by bucket, then by video; rows by bucket


def test_work_follows_the_budget_and_not_the_duration(spark):
    """A video of 35 years: what is looked up are the requests that its budget allows, not all halvings that could be asked for."""
    table = frames(spark, [(0, 0.1), (2**38, 0.9), (2**39, 0.2)])
    got = sampling.selected(videos(spark, 2**40), table, MEDIUM).collect()
    assert len(got) == 120 and max(r.level for r in got) < 40
    want, _ = best_first(2**40, {r.ts_ms: r.score for r in got if not r.level}, {0: 0.1, 2**38: 0.9, 2**39: 0.2}, MEDIUM)
    assert [r.ts_ms for r in sorted(got, key=lambda r: r.place or 0) if r.level] == want


def test_a_selected_verdict_stores_no_halvings(spark, tmp_path):
    """From the frames to the verdicts it is one plan with one pass of Python; nothing that grows with a video's length is written on the way."""
    rows = [(v, t, 0.9 if t == 30_000 else 0.1, 60_000) for v in range(3) for t in range(0, 60_000, 500)]
    spark.createDataFrame(rows, "video_id long, ts_ms long, score double, duration_ms long").write.parquet(str(tmp_path / "frames"))
    table = spark.read.parquet(str(tmp_path / "frames"))
    of = table.select("video_id", "duration_ms").distinct()
    chosen = sampling.selected(of, table, MEDIUM).select("video_id", F.col("served_ms").alias("ts_ms"), "score", F.lit(60_000).cast("long").alias("duration_ms")).distinct()
    made = temporal.verdicts(chosen, POLICIES["balanced"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ExistingRDD" not in plan
    assert [(r.max_score, r.independent) for r in made.collect()] == [(0.9, 1)] * 3


def test_inputs_that_are_dealt_by_video_meet(spark):
    """Frames and lengths that come dealt by video are dealt together again: adaptive execution merges the partitions of each on its own."""
    rows = spark.range(0, 60_000).select((F.col("id") % 3000).alias("video_id"), (F.col("id") * 7919 % 60_000).alias("ts_ms"), (F.col("id") % 10 / 10).alias("score"))
    of = rows.groupBy("video_id").agg((F.max("ts_ms") + 1).alias("duration_ms"))
    dealt = rows.repartition("video_id").withColumn("n", F.row_number().over(Window.partitionBy("video_id", "ts_ms").orderBy("score"))).where("n = 1").drop("n")
    made = sampling.request_stats(sampling.selected(of, dealt, MEDIUM))
    assert "xxhash64" in made._jdf.queryExecution().executedPlan().toString()
    got = made.agg(F.count("*").alias("videos"), F.sum("failed").alias("failed"), F.min("frames").alias("frames")).first()
    assert got.videos == 3000 and got.failed == 0 and got.frames > 1


def test_long_videos_with_keyframes_and_lost_frames(spark):
    """35 years with keyframes near the middles and frames that can't be read: the same requests as one after the other."""
    r, plain, keys, rows = random.Random(7), [(1, 2**40), (2, 2**40 - 12_345)], {}, {}
    for v, duration in plain:
        keys[v] = sorted({int(duration * k / 512 + r.uniform(-1e8, 1e8)) for k in range(1, 512)})
        rows[v] = {t: None if r.random() < 0.3 else round(r.random(), 3) for t in r.sample(range(duration), 200)}
    table = spark.createDataFrame(plain, "video_id long, duration_ms long")
    table_of = spark.createDataFrame([(v, t, s) for v in rows for t, s in rows[v].items()], "video_id long, ts_ms long, score double")
    kfs = spark.createDataFrame([(v, k) for v in keys for k in keys[v]], "video_id long, kf_ms long")
    got = sampling.selected(table, table_of, MEDIUM, kfs).collect()
    for v, duration in plain:
        want = sampled(duration, MEDIUM, keys[v], rows[v])
        assert sorted((x.ts_ms, x.on_keyframe, x.level) for x in got if x.video_id == v) == sorted(want)
        assert any(level and on for _, on, level in want) and any(x.score is None for x in got if x.video_id == v)


def test_keyframes_meet_frames_in_one_shuffle_and_videos_go_on_together(spark, tmp_path, monkeypatch):
    """With keyframes too the survey belongs to the step of refinement: one exchange, no window. And there a step is one of all videos of a task."""
    rows = [(v, t, v % 7 / 10 + t % 3 / 10) for v in range(300) for t in range(v, 60_000, 3000)]
    for name, made in {"frames": spark.createDataFrame(rows, "video_id long, ts_ms long, score double"), "keys": spark.createDataFrame([(v, t + 40) for v, t, _ in rows[::4]], "video_id long, kf_ms long")}.items():
        made.write.parquet(str(tmp_path / name))
    table, keys = (spark.read.parquet(str(tmp_path / name)) for name in ("frames", "keys"))
    made = sampling.selected(spark.range(300).select(F.col("id").alias("video_id"), F.lit(60_000).alias("duration_ms")), table, MEDIUM, keys)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Aggregate" not in plan

    laid = sorted([(v, sampling.LENGTH, 60_000, None) for v in range(300)] + [(v, sampling.KEYFRAME, r.kf_ms, None) for r in keys.collect() for v in [r.video_id]] + [(v, sampling.FRAME, t, s) for v, t, s in rows], key=lambda x: x[:3])
    calls = []
    ranks = sampling.ranks
    monkeypatch.setattr(sampling, "ranks", lambda *a: calls.append(1) or ranks(*a))
    group = pa.table(dict(zip(["video_id", "side", "ts_ms", "score"], map(list, zip(*laid, strict=True)), strict=True)))
    got = sampling._requests(group, MEDIUM, True)
    assert len(calls) < 20 and len(got["ts_ms"]) == made.count() > 300 * 100


@pytest.mark.parametrize("batch", [1, 37, 1000])
def test_videos_are_never_cut_apart(batch, monkeypatch):
    """Whatever the batches, a group has whole videos, and no more rows than its bound, one video and a batch."""
    monkeypatch.setattr(sampling, "ROWS", 100)
    ids = [v for v, n in enumerate([1, 250, 37, 37, 3, 90, 1, 1, 74, 400, 2]) for _ in range(n)]
    groups = [g.column("video_id").to_pylist() for g in sampling._groups(iter(pa.table({"video_id": ids}).to_batches(max_chunksize=batch)))]
    assert sum(groups, []) == ids and all(a[-1] != b[0] for a, b in zip(groups, groups[1:], strict=False))
    assert batch == 1000 or max(map(len, groups)) <= 100 + 400 + batch


def test_selected_verdict_lays_out_no_requests(spark):
    """Between the frames and the step of selection there are lengths and frames only: survey requests aren't rows of a shuffle."""
    plan = registry.selected_verdict(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan


def test_videos_that_can_hardly_be_read(spark):
    """Where most requests fail, far more of them than the budget's frames are made, beside videos that fail never: in the order of a heap."""
    r, budget, rows = random.Random(5), Budget(survey_frames=6, max_frames=30, min_gap_ms=250), {}
    for v, lost in enumerate([0.97, 0.9, 0.0, 0.8]):
        rows[v] = {t: None if r.random() < lost else round(r.random(), 2) for t in r.sample(range(100_000), 900)}
    rows[0] |= {t: 0.5 for t in range(8_333, 100_000, 16_667)}
    frames = spark.createDataFrame([(v, t, s) for v in rows for t, s in rows[v].items()], "video_id long, ts_ms long, score double")
    got = sampling.selected(spark.createDataFrame([(v, 100_000) for v in rows], "video_id long, duration_ms long"), frames, budget).collect()
    for v in rows:
        mine = sorted((x for x in got if x.video_id == v and x.level), key=lambda x: x.place)
        survey = sorted((x.ts_ms, x.score) for x in got if x.video_id == v and not x.level)
        seen, failed, times = [x for x in survey if x[1] is not None], [t for t, s in survey if s is None], sorted(rows[v])
        waiting, want, room = [], [], budget.max_frames - len(seen)

        def wait(a, b, x, y, bound, level, waiting=waiting):
            if b - a >= 500:
                rank = math.floor((0.15 + max(x, y)) * math.log2(1 + (b - a) / 250) * 1e9 + 0.5) / 1e9
                heapq.heappush(waiting, (-min(bound, rank), level, a, b, x, y))

        ends = [(0, seen[0][1]), *seen, (100_000, seen[-1][1])] if seen else []
        for (a, x), (b, y) in zip(ends, ends[1:], strict=False):
            wait(a, b, x, y, math.inf, 1)
        while waiting and room > 0:
            q, level, a, b, x, y = heapq.heappop(waiting)
            t = (a + b + 1) // 2
            if t not in failed:
                s = rows[v][times[max(0, bisect.bisect_right(times, t) - 1)]]
                want.append((t, level, -q, s))
                room -= s is not None
                wait(a, t, x, x if s is None else s, -q, level + 1)
                wait(t, b, y if s is None else s, y, -q, level + 1)
        assert [(x.ts_ms, x.level, x.priority, x.score) for x in mine] == want
    assert max(sum(x.video_id == v for x in got) for v in rows) > 100


def test_the_search_has_the_tasks_that_shuffles_are_given(spark):
    """It takes far longer than its few bytes let adaptive execution expect, which merged them to one task."""
    rows = spark.range(0, 3000).select((F.col("id") % 300).alias("video_id"), (F.col("id") * 7919 % 60_000).alias("ts_ms"), (F.col("id") % 10 / 10).alias("score"))
    made = sampling.selected(spark.range(300).select(F.col("id").alias("video_id"), F.lit(60_000).alias("duration_ms")), rows, MEDIUM)
    tasks = made.select("video_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == 300 and {r.task for r in tasks} == {0, 1, 2, 3}


def test_of_frames_delivered_again_the_first_counts(spark):
    r = random.Random(3)
    rows = [(v, t, None if r.random() < 0.2 else round(r.random(), 3), n) for v in range(5) for n, t in enumerate(r.choices(range(0, 60_000, 500), k=300))]
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "video_id long, ts_ms long, score double, arrival long")
    first = {(v, t): s for v, t, s, _ in sorted(rows, key=lambda x: -x[3])}
    once = spark.createDataFrame([(v, t, s) for (v, t), s in first.items()], "video_id long, ts_ms long, score double")
    of = spark.createDataFrame([(v, 60_000) for v in range(5)], "video_id long, duration_ms long")
    keys = table.where("arrival % 9 = 0").select("video_id", F.col("ts_ms").alias("kf_ms"))
    of_all, of_one = (sorted(map(tuple, sampling.selected(of, x, MEDIUM, keys, **how).collect()), key=str) for x, how in ((table, {"arrival": "arrival"}), (once, {})))
    assert of_all == of_one and len(of_all) > 300


@pytest.mark.parametrize("name", ["refine_plan", "snapped_refinement", "scan_stats", "selected_verdict"])
def test_deliveries_are_dealt_and_put_in_order_once(spark, name):
    """On their way to the search they meet lengths and keyframes, and the first of a time is found there."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("MapInArrow") :]
    assert before.count("REPARTITION_BY_") == 1 and before.count(" Sort [") == 1
