import pytest
from pyspark.sql import functions as F

from tidemark.operators import detectors, lookups, metrics, mitigation


def timings(spark, values):
    return spark.createDataFrame([("t", k, float(v)) for k, v in enumerate(values)], "name string, seq long, ms double")


def test_histogram(spark):
    r = metrics.histograms(timings(spark, range(1, 101))).first()
    assert (r["count"], r.p50, r.p95, r.mean, r.max) == (100, 50, 95, 50.5, 100)
    r = metrics.histograms(timings(spark, [999, 20, 20, 20, 20, 20]), reservoir=4).first()
    assert (r["count"], r.p50, r.mean, r.max) == (6, 20, 20, 999)
    assert metrics.histograms(timings(spark, [float("nan"), float("inf"), -1])).count() == 0


def test_counters_and_latest(spark):
    rows = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "a", 3)], "scan_id long, name string, n long")
    assert metrics.counters(rows).first().counters == {"a": 5, "b": 1}
    events = spark.createDataFrame([(1, 1, "x"), (1, 3, "z"), (1, 2, "y")], "scan_id long, seq long, type string")
    assert metrics.latest(events, "scan_id", "seq").first().type == "z"
    assert metrics.throughput(rows, "scan_id", "a", F.lit(0.0)).first().per_second == 0


def test_merged_detectors(value):
    m = lambda **s: F.create_map(*[x for k, v in s.items() for x in (F.lit(k), F.lit(float(v)))])
    assert value(detectors.merged([m(sexual=0.8), m(violence=0.3, gore=0.1)])) == {"sexual": 0.8, "violence": 0.3, "gore": 0.1}
    assert value(detectors.merged([m(sexual=float("nan")), m(sexual=0.2)])) == {"sexual": 0.2}
    assert value(detectors.merged([])) == {}


def test_classify_by_an_injected_model(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "frame_id long, pixels array<double>")

    def load():
        return lambda batch: [[p[0], 0.0, 0.0, p[1], 0.0] for p in batch]

    got = {r.frame_id: r.classes.Porn for r in detectors.classify(rows, load).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_merge_rows(spark):
    rows = spark.createDataFrame([(1, {"a": 0.1, "b": 0.5}), (1, {"a": 0.3}), (2, {})], "frame_id long, categories map<string,double>")
    assert {r.frame_id: r.categories for r in detectors.merge_rows(rows).collect()} == {1: {"a": 0.3, "b": 0.5}, 2: {}}


def test_lookups(spark):
    left = spark.createDataFrame([(1, t) for t in (0, 5, 10, 15, 99)] + [(2, 3)], "k long, t long")
    right = spark.createDataFrame([(1, 4), (1, 10), (1, 20)], "k long, r long")
    got = {(x.k, x.t): x.out for x in lookups.as_of(left, right, "k", "t", "r", "out").collect()}
    assert got == {(1, 0): 4, (1, 5): 4, (1, 10): 10, (1, 15): 10, (1, 99): 20, (2, 3): None}
    got = {(x.k, x.t): x.out for x in lookups.nearest(left, right, "k", "t", "r", "out", 5).collect()}
    assert got == {(1, 0): 4, (1, 5): 4, (1, 10): 10, (1, 15): 10, (1, 99): None, (2, 3): None}


def test_spans_are_inclusive(spark):
    points = spark.createDataFrame([(1, t) for t in (4149, 4150, 7100, 7101, 90_000)] + [(2, 5000)], "video_id long, ts_ms long")
    spans = spark.createDataFrame([(1, 4400, 7100), (1, 4400, 7100)], "video_id long, start_ms long, end_ms long")
    assert sorted(r.ts_ms for r in mitigation.restricted_points(points, spans).collect()) == [4150, 7100]


@pytest.mark.parametrize(("coverage", "in_span", "expected"), [(1.0, False, False), (1.0, True, True), (0.5, False, True)])
def test_blur(spark, coverage, in_span, expected):
    state = spark.createDataFrame(
        [("blur", "done", True, True, 2, coverage, in_span, False, False)],
        "mode string, phase string, finalized boolean, flagged boolean, segments int, coverage double, in_span boolean, revealing boolean, acknowledged boolean",
    )
    assert mitigation.obscured(state).first().obscured is expected
