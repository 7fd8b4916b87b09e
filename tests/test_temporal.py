import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.constants import POLICIES
from tidemark.operators import temporal
from tidemark.streaming import progress

BALANCED = POLICIES["balanced"]


def cells(n, duration):
    return " ".join(f"{int((k + 0.5) * duration / n)}:0" for k in range(n))


@pytest.mark.parametrize(("text", "duration", "expected"), [(cells(16, 30_000), 30_000, 1.0), ("5000:0 5200:0", 60_000, 4200 / 60_000)])
def test_coverage(frames, text, duration, expected):
    assert temporal.coverage(frames(text, duration)).first().coverage == pytest.approx(expected)


def test_sparse_coverage_is_low(frames):
    assert 0 < temporal.coverage(frames(cells(16, 7_200_000), 7_200_000)).first().coverage < 0.02
    assert temporal.coverage(frames("5:0", 0)).first().coverage == 0


@pytest.mark.parametrize(
    ("text", "policy", "positive", "flagged", "independent"),
    [
        ("1000:.7", "balanced", False, 1, 1),
        ("1000:.7 9000:.72", "balanced", True, 2, 2),
        ("1000:.7 1100:.72", "balanced", False, 2, 1),
        ("4000:.97", "balanced", True, 1, 1),
        ("1000:.45", "strict", True, 1, 1),
        ("1000:.45", "balanced", False, 0, 0),
    ],
)
def test_verdicts(frames, text, policy, positive, flagged, independent):
    row = temporal.verdicts(frames(text, 30_000), POLICIES[policy]).first()
    assert (row.contains_inappropriate_content, row.flagged, row.independent) == (positive, flagged, independent)


def test_confidence_of_a_strong_positive(frames):
    assert 0.8 < temporal.verdicts(frames("1000:.88 5000:.84 9000:.86 20000:.1", 30_000), BALANCED).first().confidence < 0.95


def test_independence_is_greedy(value):
    times = F.array(*[F.lit(t).cast("long") for t in (0, 300, 500, 800, 1000)])
    assert value(temporal.independent(times, 400)) == 3  # 0, 500, 1000: not the gaps between neighbours
    assert value(temporal.independent(times, 0)) == 5


@pytest.mark.parametrize(
    ("text", "duration", "expected"),
    [
        ("5000:.8 6000:.9 6500:.7", 60_000, [(4400, 7100, 0.9, 6000)]),
        ("5000:.8 30000:.8", 60_000, [(4400, 5600, 0.8, 5000), (29400, 30600, 0.8, 30000)]),
        ("100:.9 29900:.9", 30_000, [(0, 700, 0.9, 100), (29300, 30000, 0.9, 29900)]),
        ("5000:.8 7000:.8", 60_000, [(4400, 7600, 0.8, 5000)]),
        ("5000:.8 7001:.8", 60_000, [(4400, 5600, 0.8, 5000), (6401, 7601, 0.8, 7001)]),
        ("1:.1", 60_000, []),
    ],
)
def test_segments(frames, text, duration, expected):
    rows = temporal.segments(frames(text, duration), BALANCED).orderBy("segment").collect()
    assert [(r.start_ms, r.end_ms, r.peak_score, r.peak_ts_ms) for r in rows] == expected


@pytest.mark.parametrize(("text", "expected"), [("1000:.2", False), ("1000:.995", True), ("1000:.9 5000:.88 9000:.91", True), ("1000:.57 9000:.58", False)])
def test_early_exit(frames, text, expected):
    assert temporal.evidence(frames(text), BALANCED).select(temporal.early_exit(BALANCED).alias("x")).first().x is expected


def test_category_peaks(spark):
    rows = [(1, {"sexual": 0.4, "violence": 0.4}), (1, {"sexual": float("nan"), "gore": -1.0}), (2, {})]
    got = temporal.category_peaks(spark.createDataFrame(rows, "video_id long, categories map<string,double>")).orderBy("place").collect()
    assert [(r.category, r.peak, r.place) for r in got] == [("sexual", 0.4, 1), ("violence", 0.4, 2), ("gore", 0.0, 3)]


def test_greedy_counts_of_long_videos(spark):
    """Streams past the counts equal the fold over an array, for several rules at once and videos in any order."""
    import random

    rng = random.Random(2)
    rows = [(v, t, rng.random()) for v, n in ((1, 20_000), (2, 40), (3, 1)) for t in rng.sample(range(200_000), n)] + [(4, 5, 0.1), (None, 7, 0.9)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "video_id long, ts_ms long, score double").repartition(6)
    rules = [("strict", 0.3, 0), ("balanced", 0.55, 400), ("permissive", 0.75, 1000)]
    got = {r.video_id: tuple(r)[1:] for r in temporal.independents(table, rules).collect()}

    def counted(video, least, gap):
        n, anchor = 0, None
        for t in sorted(t for v, t, s in rows if v == video and s >= least):
            if gap <= 0 or anchor is None or t - anchor >= gap:
                n, anchor = n + 1, t
        return n

    want = {v: tuple(counted(v, *rule[1:]) for rule in rules) for v in (1, 2, 3, None)}
    assert got == {v: c for v, c in want.items() if any(c)}


def test_stream_and_table_agree(spark, frames, tmp_path):
    rows = frames("9000:.72 1000:.7 1000:.99 4000:.1", 30_000)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = progress.run(spark, stream, BALANCED, str(tmp_path / "out")).collect()
    once = progress.snapshots(rows, BALANCED).collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in once]
    assert once[0].n_frames == 3 and once[0].contains_inappropriate_content


def test_stream_writes_its_events(spark, frames, tmp_path):
    rows = frames("9000:.72 1000:.7 4000:.1", 30_000)
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    progress.run(spark, stream, BALANCED, str(tmp_path / "out"))
    told = progress.events(spark, str(tmp_path / "out")).orderBy("batch").collect()
    assert [r.type for r in told][-1] == "done" and {r.type for r in told[:-1]} == {"progress"} and len(told) >= 2
    last = json.loads(told[-2].result)
    assert set(last) == {"contains_inappropriate_content", "confidence"} and last["contains_inappropriate_content"] is True


def test_a_stream_that_fails_says_so(spark, frames, tmp_path):
    rows = frames("9000:.72", 30_000)
    rows.write.parquet(str(tmp_path / "in"))
    broken = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withColumn("score", F.raise_error(F.lit("no pixels")).cast("double"))
    with pytest.raises(StreamingQueryException):
        progress.run(spark, broken, BALANCED, str(tmp_path / "out"))
    told = progress.events(spark, str(tmp_path / "out")).collect()
    assert [r.type for r in told] == ["error"] and "no pixels" in told[0].message and told[0].kind == "stream"


def test_a_stopped_stream_goes_on_where_it_was(spark, frames, tmp_path):
    rows = frames("9000:.72 1000:.7 4000:.1", 30_000)
    rows.where("ts_ms = 9000").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    progress.start(stream(), BALANCED, str(tmp_path / "out")).awaitTermination()
    rows.where("ts_ms <> 9000").write.mode("append").parquet(str(tmp_path / "in"))
    again = progress.start(stream(), BALANCED, str(tmp_path / "out"), every="100 milliseconds")
    again.processAllAvailable()
    again.stop()
    assert [r.asDict() for r in progress.published(spark, str(tmp_path / "out")).collect()] == [r.asDict() for r in progress.snapshots(rows, BALANCED).collect()]


def test_session_windows_are_flagged_spans(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 0.8), (1, "2024-01-01 00:00:02", 0.9), (1, "2024-01-01 00:00:09", 0.7)], "video_id long, t string, score double")
    made = progress.sessions(rows.withColumn("t", F.col("t").cast("timestamp")), "t").orderBy("span").collect()
    assert [(r.frames, r.peak_score) for r in made] == [(2, 0.9), (1, 0.7)]


def test_observed_metrics(frames):
    rows, seen = progress.observed(frames("1:.2 2:.9"))
    assert rows.count() == 2 and seen.get == {"rows": 2, "high_share": 0.5, "max_score": 0.9}


def test_empty(frames):
    none = frames("1:.9").where("score > 5")
    assert temporal.verdicts(none, BALANCED).count() == 0 and temporal.segments(none, BALANCED).count() == 0


def test_streaming_cache_equals_the_batch_fold(spark, tmp_path):
    import random

    from tidemark.operators import near
    from tidemark.streaming import cache

    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = [(v, k, f"{0 if rng.random() < 0.1 else rng.choice(base) ^ (1 << rng.randrange(64)):016x}", rng.random()) for v in (1, 2, 3) for k in range(80)]
    schema = "video_id long, arrival long, hash string, score double"
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 20 == part], schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={part}"))
    cache.with_state_store(spark)
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "false").parquet(str(tmp_path / "in"))
    query = (
        cache.cached_scores(stream.drop("part"), capacity=5)
        .writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "state"))
        .foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/n={n}")))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = {(r.video_id, r.arrival): (r.score, r.inherited) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.video_id, r.arrival): (r.score, r.inherited) for r in near.cached_scores(spark.createDataFrame(rows, schema), capacity=5).collect()}
    assert got == want and any(i for _, i in want.values())
