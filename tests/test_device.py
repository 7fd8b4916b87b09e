import math

import pytest
from pyspark.sql import functions as F

from tidemark.constants import BUDGETS
from tidemark.functions import device, formats


@pytest.mark.parametrize(
    ("webgpu", "webgl", "cores", "memory", "expected"),
    [(False, False, 8, 8, "low"), (True, True, 8, 2, "low"), (True, True, 2, 8, "low"), (True, True, 12, 8, "high"), (False, True, 12, 8, "medium"), (True, True, 12, None, "high")],
)
def test_tier(value, webgpu, webgl, cores, memory, expected):
    got = device.tier(F.lit(webgpu), F.lit(webgl), F.lit(cores), F.lit(memory).cast("double"))
    assert value(got) == expected


def test_budgets(value):
    for name, b in BUDGETS.items():
        assert value(device.budget(F.lit(name))).max_frames == b.max_frames
    saved = value(device.budget(F.lit("low"), F.lit(True)))
    assert (saved.survey_frames, saved.max_frames, saved.max_ms) == (6, 24, 5400)


def test_description_and_chain(value):
    assert value(device.describe(F.lit("high"), F.lit("webgpu"), F.lit(12), F.lit(8.0), F.lit(True))) == "high tier - webgpu - 12 cores - 8 GB - WebCodecs"
    assert value(device.backend_chain(F.lit("wasm"))) == ["wasm", "cpu"]
    assert len(value(device.backend_chain(F.lit("auto")))) == 4
    assert value(device.cores_of(F.lit(None).cast("int"))) == 2


@pytest.mark.parametrize(("p50", "n", "frames", "gap"), [(500.0, 3, 120, 250), (1.4 * 45, 40, 120, 250), (90.0, 40, 60, 500), (9000.0, 40, 40, 500)])
def test_governor(value, p50, n, frames, gap):
    got = value(device.governed(F.lit(120), F.lit(250), F.lit(45), F.lit(p50), F.lit(n)))
    assert (got.max_frames, got.min_gap_ms) == (frames, gap)


def test_resolution_floor(value):
    at = lambda n: value(device.resolution_floor(F.lit(250), F.lit(n), F.lit(60_000)))
    assert (at(0), at(2), at(3), at(200)) == (250, 250, 400, 7500)


@pytest.mark.parametrize(
    ("local", "size", "api", "iso", "kind"),
    [(True, 10, False, True, "video-element"), (False, 10, True, True, "video-element"), (True, 10, True, False, "video-element"), (True, 2**29, True, True, "video-element"), (True, None, True, True, "webcodecs"), (True, 300 * 2**20, True, True, "webcodecs")],
)
def test_source_kind(value, local, size, api, iso, kind):
    assert value(device.source_kind(F.lit(local), F.lit(size).cast("long"), F.lit(api), F.lit(iso))).kind == kind


def test_sniff_and_validation(spark, value, tmp_path):
    from tidemark.sources import container

    (tmp_path / "a.mp4").write_bytes(b"\0\0\0\x18ftypmp42" + b"\0" * 80)
    (tmp_path / "b.webm").write_bytes(b"\x1aE\xdf\xa3" + b"\0" * 80 + b"ftyp")
    got = {r.path[-6:]: r.iso_bmff for r in container.sniffed(spark, str(tmp_path), "*.[mw]*").collect()}
    assert got == {"/a.mp4": True, "b.webm": False}
    for url, ok in (("https://x.org/a", True), (" HTTP://x.org/a ", True), ("ftp://x.org/a", False), ("nonsense", False), ("", False)):
        assert value(device.accepts_url(F.lit(url))) is ok
    assert value(device.accepts_mime(F.lit(""))) and value(device.accepts_mime(F.lit("video/mp4"))) and not value(device.accepts_mime(F.lit("text/html")))


def test_manifests(spark, tmp_path):
    from tidemark.sources import container

    (tmp_path / "m.json").write_text('{"labels":["a","b"],"violenceIndex":1}\n{"labels":["a"],"violenceIndex":3}\nbroken\n{"labels":[],"violenceIndex":0}\n')
    rows = container.manifests(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].inputSize == 224 and rows[0].mean == [0.5] * 3


def test_container_stats(spark):
    from tidemark.sources import container

    rows = [(1, 40 * k, 40, k % 50 == 0) for k in range(200)] + [(2, 0, 0, False), (2, 30, 0, False)]
    got = {r.video_id: r for r in container.container_stats(spark.createDataFrame(rows, "video_id long, ts_ms long, duration_ms long, is_sync boolean")).collect()}
    assert (got[1].duration_ms, got[1].keyframes, got[1].frame_ms, got[1].keyframe_gap_ms) == (8000, 4, 40.0, 2000)
    assert (got[2].keyframes, got[2].frame_ms, got[2].keyframe_gap_ms) == (1, 40.0, None)


@pytest.mark.parametrize(
    ("make", "given", "expected"),
    [
        ("timestamp", -5.0, "0:00"), ("timestamp", 5000.0, "0:5.0"), ("timestamp", 65_000.0, "1:05"), ("timestamp", 3_725_000.0, "1:02:05"),
        ("byte_size", 0, "0 B"), ("byte_size", 1536, "1.5 KB"), ("byte_size", 300 * 2**20, "300 MB"),
        ("duration", float("nan"), "-"), ("duration", 0.5, "0.50 ms"), ("duration", 1500.0, "1.50 s"), ("percent", 0.515, "52%"),
    ],
)
def test_formats(value, make, given, expected):
    assert value(getattr(formats, make)(F.lit(given))) == expected


def test_tenths_of_seconds_are_rounded_as_in_sql(spark):
    """Ties go to even, and what only looks like one is rounded by the double itself, at every ms below a minute."""
    got = spark.range(60_000).select("id", formats.timestamp(F.col("id")).alias("x")).collect()
    assert [r for r in got if r.x != f"0:{r.id / 1000:.1f}"] == []


def test_crops(value):
    assert value(device.crops(F.lit(640), F.lit(360), "centerCrop"))[0].x == 140
    assert [c.x for c in value(device.crops(F.lit(640), F.lit(360), "multiCrop"))] == [0, 280]
    assert value(device.crops(F.lit(400), F.lit(360), "multiCrop")) == []


def test_probe(value):
    d = lambda x: F.lit(x).cast("double")
    assert value(device.resolved_duration(d(float("inf")), d(None), d(9000.0))) == 9000
    assert value(device.resolved_duration(d(None), d(0.0), d(None))) is None
    assert value(device.seek_target(F.lit(70_000), F.lit(60_000))) == 59_950 and value(device.seek_target(F.lit(-3), F.lit(60_000))) == 0
    assert value(device.probe_result(d(5.0), F.lit("ok"))).ok
    assert [value(device.probe_result(d(None), F.lit(r))).kind for r in ("ok", "tainted", "failed")] == ["live", "cors", "decode"]


def test_notes_and_gap(value):
    b = F.lit
    assert value(device.usable_probe(F.lit(None).cast("boolean"))) is False
    assert value(device.notes(b(True), b(True), b(True), b(True))) == []
    said = value(device.notes(b(True), b(False), b(False), b(False)))
    assert len(said) == 3 and "adapter" in said[0] and "codec" in said[1] and "GPU backend" in said[2]
    assert value(device.notes(b(False), b(False), b(True), b(True))) == []
    assert [value(device.sampling_gap(F.lit(250), F.lit(r).cast("double"))) for r in (40.0, 250.4, 3000.5, None)] == [250, 250, 3001, 250]


def test_timeline_axis(value):
    marks = value(formats.timeline_axis(F.lit(240_000).cast("double")))
    assert [(m.share, m.label) for m in marks] == [(0.0, "0:0.0"), (0.25, "1:00"), (0.5, "2:00"), (0.75, "3:00"), (1.0, "4:00")]


def test_events_thumbnails_and_phases(value, spark):
    from tidemark.operators import mitigation
    from tidemark.sources import sinks

    made = value(sinks.event("error", message=F.lit("why"), kind=F.lit("cors")))
    assert made.asDict() == {"type": "error", "phase": None, "message": "why", "kind": "cors", "result": None}
    rows = spark.createDataFrame([(0.6, "a"), (0.5, "b")], "score double, thumbnail string")
    assert [r.t for r in rows.select(sinks.thumbnail(0.55).alias("t")).collect()] == ["a", None]
    assert [value(mitigation.is_scanning(F.lit(p).cast("string"))) for p in ("survey", "refine", "done", "cancelled", None)] == [True, True, False, False, False]


def test_interval_priority(value):
    from tidemark.functions.scoring import interval_priority

    assert value(interval_priority(F.lit(1000), F.lit(0.2), F.lit(0.6), F.lit(250))) == pytest.approx(0.75 * math.log2(5))


def test_model_fitness(spark):
    from tidemark.operators.detectors import fit_for_use

    rows = spark.createDataFrame([([1.0, 0.0], True), ([2.0, 5.0], True), ([3.0, -1.0], True), ([0.0, 9.0], False)], "logits array<double>, is_clean boolean")
    r = fit_for_use(rows).first()
    assert (r.swing, r.ratio, r.fit) == (10.0, pytest.approx(2 / 3), False)
    assert fit_for_use(rows.where("NOT is_clean")).first().ratio == 0.0
    assert fit_for_use(rows.where("logits[1] < 1 OR NOT is_clean")).first().fit is True


def test_default_detail(spark):
    from tidemark.constants import POLICIES
    from tidemark.operators import detectors

    rows = spark.createDataFrame([(1, [0.0, 2.0])], "frame_id long, logits array<double>")
    r = detectors.detect(rows, [detectors.LogitDetector()], POLICIES["balanced"]).first()
    assert r.classes.asDict() == {"Drawing": 0.0, "Hentai": 0.0, "Neutral": 1.0, "Porn": 0.0, "Sexy": 0.0}
