"""Stop reasons, first verdicts and outcomes, and histograms of streams."""

import random

import pytest

from tidemark.constants import Budget
from tidemark.operators import metrics, outcomes
from tidemark.streaming import reservoirs

SCHEMA = "video_id long, step int, ts_ms long, survey boolean, failed boolean, cancelled boolean, elapsed_ms long"


def loop(log, budget):
    """A scan's log (ts, survey, failed, cancelled, elapsed), one request after the other."""
    seen, failed, twice, spent, first, stop, k = set(), 0, 0, 0, None, None, 0
    while True:
        if k < len(log) and log[k][3]:
            stop = "cancelled"
        elif len(seen) >= budget.max_frames:
            stop = "frame-budget"
        elif spent > budget.max_ms:
            stop = "time-budget"
        if stop:
            break
        taken = log[k] if k < len(log) else None
        if first is None and not any(x[1] for x in log[k + 1 :]) and seen:
            first = spent
        if taken is None:
            stop = "complete"
            break
        ts, _, bad, _, spent = taken
        failed += bad
        twice += not bad and ts in seen
        seen |= set() if bad else {ts}
        k += 1
    if first is None and seen:
        first = spent
    return stop, "no-frames" if not seen and stop != "cancelled" else stop, len(seen), failed, twice, spent, first


@pytest.mark.parametrize("seed", range(3))
def test_scans_end_as_a_loop_ends_them(spark, seed):
    r, budget, logs = random.Random(seed), Budget(max_frames=6, max_ms=900), {}
    for v in range(60):
        n, spent, rows = r.choice([1, 2, 5, 20]), 0, []
        for k in range(n):
            spent += r.randrange(150)
            rows.append((r.randrange(12), k < r.choice([1, 4]), r.random() < r.choice([0.1, 1.0 if v % 7 == 0 else 0.3]), k > 0 and r.random() < 0.03, spent))
        survey = [x[1] for x in rows]
        logs[v] = [(t, all(survey[: k + 1]), f, c, e) for k, (t, _, f, c, e) in enumerate(rows)]
    table = spark.createDataFrame([(v, k, t, s, f, c, e) for v, rows in logs.items() for k, (t, s, f, c, e) in enumerate(rows)], SCHEMA).repartition(3)
    got = {x.video_id: tuple(x)[1:] for x in outcomes.outcomes(outcomes.recorded(table), budget).collect()}
    assert got == {v: loop(rows, budget) for v, rows in logs.items()}
    assert {x[0] for x in got.values()} >= {"complete", "frame-budget"}


def test_a_log_without_rows(spark):
    assert outcomes.outcomes(outcomes.recorded(spark.createDataFrame([], SCHEMA)), Budget()).count() == 0


@pytest.mark.parametrize("shards", [1, 4])
def test_histograms_of_a_stream_in_any_order_equal_the_batch(spark, tmp_path, shards):
    r = random.Random(shards)
    rows = [(r.choice(["decode", "decode", "infer"]), k, r.choice([r.random() * 100, 0.0, -1.0, float("nan"), float("inf"), None])) for k in range(900)] + [("odd", 1, -5.0)]
    r.shuffle(rows)
    schema = "name string, seq long, ms double"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).drop("part")
    got = reservoirs.histograms(stream, str(tmp_path / "out"), reservoir=50, shards=shards)
    want = metrics.histograms(spark.createDataFrame(rows, schema), reservoir=50)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_source_is_held_back_to_so_many_files(spark, tmp_path):
    """As many micro-batches as files, at one file each; the histogram is the same."""
    from tidemark.sources import frames as sources

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.createDataFrame([(k, None, k % 3, "view", float(k), None) for k in range(40)], schema)
    rows.repartition(4).write.parquet(str(tmp_path / "sf/events.parquet"))
    stream = sources.event_stream(spark, str(tmp_path / "sf"), files_per_trigger=1)
    timings = stream.selectExpr("event_type AS name", "event_id AS seq", "value AS ms")
    found = reservoirs.histograms(timings, str(tmp_path / "out")).collect()
    assert [(r["name"], r["count"], r["p50"]) for r in found] == [("view", 40, 19.0)]
    assert len(list((tmp_path / "out/published").glob("number=*"))) >= 4
