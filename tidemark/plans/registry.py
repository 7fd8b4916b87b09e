"""The registered queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.constants import BUDGETS, CLASSES, DEFAULT_POLICY, POLICIES, Budget
from tidemark.functions import device, formats, hashing, scoring
from tidemark.functions.scoring import round_to
from tidemark.operators import detectors, lookups, metrics, mitigation, near, near_groups, outcomes, sampling, temporal
from tidemark.plans import sql
from tidemark.sources import container, sinks
from tidemark.sources import frames as sources
from tidemark.streaming import progress, reservoirs

BALANCED = POLICIES[DEFAULT_POLICY]


def six(x: Column | str) -> Column:
    return round_to(F.col(x) if isinstance(x, str) else x, 6)


def scan_verdict(policy: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.verdicts(sources.frames(spark, sf_dir), POLICIES[policy])
    return rows.select(
        "video_id", "n_frames", six("max_score").alias("max_score"), six("topk_mean").alias("topk_mean"), "flagged", "independent", six("coverage").alias("coverage"), "contains_inappropriate_content", "confidence"
    )


def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every video under every policy."""
    return temporal.verdicts_under(sources.frames(spark, sf_dir), list(POLICIES.values()))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.segments(sources.bucketed_frames(spark, sf_dir), BALANCED).withColumn("peak_score", six("peak_score"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.coverage(sources.bucketed_frames(spark, sf_dir)).withColumn("coverage", six("coverage"))


def independent_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags at 0.3, counted once in 400 ms."""
    rows = sources.frames(spark, sf_dir)
    return temporal.independents(rows, [("flagged", 0.3, 0), ("independent", 0.3, 400)])


def topk_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.top_mean(sources.frames(spark, sf_dir)).withColumn("topk_mean", six("topk_mean"))


def early_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = POLICIES["strict"]
    rows = temporal.evidence(sources.frames(spark, sf_dir), strict)
    return rows.select("video_id", temporal.early_exit(strict).alias("early_exit"))


def verdict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.verdicts(sources.frames(spark, sf_dir), BALANCED)
    return rows.select("video_id", temporal.verdict_json(rows).alias("verdict"))


def restricted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as a report shows them: times as text, place on the timeline."""
    rows = temporal.segments(sources.bucketed_frames(spark, sf_dir), BALANCED).withColumn("d", F.lit(sources.DURATION_MS).cast("double"))
    box = formats.timeline_box(F.col("start_ms"), F.col("end_ms"), F.col("d"))
    return rows.select("video_id", "segment", formats.timestamp(F.col("start_ms")).alias("starts"), six(box["left_pct"]).alias("left_pct"), six(box["width_pct"]).alias("width_pct"), formats.percent(F.col("peak_score")).alias("peak"))


def peak_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as the frames of a video."""
    return temporal.category_peaks(sources.categories(spark, sf_dir), "source")


def merge_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two detectors per document, of which the second doubts the first's violence score; absent categories stay absent."""
    rows = sources.categories(spark, sf_dir)
    second = F.map_filter(F.transform_values("categories", lambda k, v: v * 0.5 + 0.25), lambda k, v: k == "violence")
    made = rows.withColumn("merged", detectors.merged([F.col("categories"), second]))
    at = lambda k: F.try_element_at(F.col("merged"), F.lit(k))
    return made.select("doc_id", F.size("merged").cast("long").alias("n_categories"), at("sexual").alias("sexual"), at("violence").alias("violence"))


def combine_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.categories(spark, sf_dir)
    return rows.select("doc_id", scoring.combined(F.col("categories")).alias("score"), scoring.combined(F.col("categories"), {"violence": 0.5}).alias("half_violence"))


def screened_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: the categories that some document was screened for, and the others."""
    rows = sources.categories(spark, sf_dir).select("source", F.explode_outer(F.map_keys("categories")).alias("c"))
    sets = rows.groupBy("source").agg(F.array_sort(F.collect_set("c")).alias("screened"))
    return sets.select("source", F.array_join("screened", ",").alias("screened"), F.array_join(scoring.unscreened(F.col("screened")), ",").alias("unscreened"))


def frame_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.class_vectors(spark, sf_dir).withColumn("classes", scoring.class_struct(F.col("probabilities")))
    return rows.select("frame_id", *[six(scoring.frame_score(F.col("classes"), p)).alias(p.id) for p in POLICIES.values()])


def dominant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.class_vectors(spark, sf_dir).withColumn("classes", scoring.class_struct(F.col("probabilities")))
    return rows.select("frame_id", scoring.dominant_class(F.col("classes")).alias("dominant"))


def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.class_vectors(spark, sf_dir).select("frame_id", F.posexplode("probabilities").alias("at", "p"))
    return rows.select("frame_id", F.col("at").cast("long").alias("at"), six("p").alias("p"))


def detector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and logit detectors plugged in: merged categories, combined score, screened and unscreened categories; and the
    detail that a frame has where no detector gives one."""
    rows = sources.class_vectors(spark, sf_dir).withColumn("classes", scoring.class_struct(F.col("probabilities")))
    made = detectors.detect(rows, [detectors.ClassDetector(), detectors.LogitDetector("logits", 1)], BALANCED)
    only = detectors.detect(rows.select("frame_id", "logits"), [detectors.LogitDetector("logits", 1)], BALANCED)
    detail = only.select("frame_id", F.col("classes.Neutral").alias("neutral_by_default"))
    shown = made.select("frame_id", six("score").alias("score"), F.array_join("screened", ",").alias("screened"), F.array_join("unscreened", ",").alias("unscreened"))
    return shown.join(detail, "frame_id")


def merge_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two crops of a frame, from the halves of its embedding: the highest value per class."""
    half = F.ceil(F.size("embedding") / 2).cast("int")
    parts = F.array(F.slice("embedding", F.lit(1), half), F.slice("embedding", half + 1, half))
    rows = sources.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.transform(parts, sources.class_logits).alias("crops"))
    crops = rows.withColumn("crops", F.transform("crops", scoring.softmax)).withColumn("crops", F.transform("crops", scoring.class_struct))
    made = crops.select("frame_id", scoring.merged_crops(F.col("crops")).alias("m"))
    return made.select("frame_id", *[six(F.col(f"m.{c}")).alias(c.lower()) for c in CLASSES])


def hit_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely a survey of 16 would meet each restricted span."""
    rows = temporal.segments(sources.bucketed_frames(spark, sf_dir), BALANCED)
    p = scoring.hit_probability(F.lit(16), (F.col("end_ms") - F.col("start_ms")).cast("double"), F.lit(float(sources.DURATION_MS)))
    return rows.select("video_id", "segment", six(p).alias("probability"))


def frame_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many seconds of the clock saw how many events."""
    rows = metrics.frames_per_second(sources.table(spark, sf_dir, "events").select("ts"), "ts")
    return rows.groupBy("fps").agg(F.count("*").alias("seconds"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts as lines of a Markdown table."""
    rows = temporal.verdicts(sources.frames(spark, sf_dir), BALANCED)
    return sinks.report_rows(rows.withColumn("elapsed_ms", F.col("n_frames") * 20))


def dhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.hashes(spark, sf_dir)


def near_dup_banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_pairs(sources.hashes(spark, sf_dir), 6)


def near_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hashes with their number of near ones, each under the least hash that near ones lead to."""
    return near_groups.near_groups(sources.hashes(spark, sf_dir), 6)


def perceptual_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of a label as a video's frames in arrival order."""
    rows = sources.hashes(spark, sf_dir).join(sources.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), "label"), "frame_id")
    frames = rows.select(F.col("label").cast("long").alias("video_id"), F.col("frame_id").alias("arrival"), "hash", (F.col("frame_id") % 97 / 97.0).alias("score"))
    return near.cached_scores(frames, threshold=12)


def first_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.frames(spark, sf_dir).select("video_id", "ts_ms", "arrival", six("score").alias("score"))


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.deliveries(spark, sf_dir).groupBy("video_id").agg((F.max("ts_ms") + 1).alias("duration_ms"))


def survey_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.survey(_videos(spark, sf_dir), BUDGETS["medium"])


def survey_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame that each survey request is served with: the last one at or before it."""
    plan = survey_plan(spark, sf_dir)
    return lookups.as_of(plan, sources.frames(spark, sf_dir), "video_id", "ts_ms", "ts_ms", "served_ms")


def keyframe_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.bucketed_frames(spark, sf_dir).select("video_id", "ts_ms")
    return lookups.as_of(rows, sources.keyframes(spark, sf_dir), "video_id", "ts_ms", "kf_ms", "kf_ms")


def nearest_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.frames(spark, sf_dir).select("video_id", "ts_ms")
    return lookups.nearest(rows, sources.keyframes(spark, sf_dir), "video_id", "ts_ms", "kf_ms", "kf_ms", 5000)


def range_mitigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose time falls into a restricted span."""
    rows = sources.bucketed_frames(spark, sf_dir)
    return mitigation.restricted_points(rows.select("video_id", "ts_ms"), temporal.segments(rows, BALANCED))


def player_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a player in blur mode shows at the end of each video."""
    rows = sources.frames(spark, sf_dir)
    spans = temporal.segments(rows, BALANCED)
    verdicts = temporal.verdicts(rows, BALANCED).select("video_id", "coverage", F.col("contains_inappropriate_content").alias("flagged"))
    ends = rows.groupBy("video_id").agg(F.max("ts_ms").alias("ts_ms"))
    inside = mitigation.restricted_points(ends, spans).select("video_id", F.lit(True).alias("in_span"))
    state = (
        verdicts.join(spans.groupBy("video_id").agg(F.count("*").alias("segments")), "video_id", "left")
        .join(inside, "video_id", "left")
        .withColumn("segments", F.coalesce("segments", F.lit(0).cast("long")))
        .withColumn("in_span", F.coalesce("in_span", F.lit(False)))
        .withColumns({"mode": F.lit("blur"), "phase": F.lit("done"), "finalized": F.lit(True), "revealing": F.lit(False), "acknowledged": F.lit(False)})
    )
    return mitigation.obscured(state).select("video_id", "segments", "in_span", "trustworthy", "obscured")


def timer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), F.col("value").alias("ms"))
    return metrics.histograms(rows)


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases per second of a video's span, as inferences."""
    rows = sources.deliveries(spark, sf_dir).withColumn("name", F.col("kind"))
    elapsed = (F.max("ts_ms") - F.min("ts_ms")) / 1000.0
    return metrics.throughput(rows, "video_id", "purchase", elapsed).withColumn("per_second", six("per_second"))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.deliveries(spark, sf_dir).select("video_id", F.col("kind").alias("name"), F.lit(1).cast("long").alias("n"))
    made = metrics.counters(rows, "video_id")
    return made.select("video_id", F.to_json("counters").alias("counters"))


def long_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), F.col("value").alias("ms"))
    return metrics.long_tasks(rows)


def timeline_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marks of every video's timeline."""
    rows = _videos(spark, sf_dir).select("video_id", F.inline(formats.timeline_axis(F.col("duration_ms"))))
    return rows.select("video_id", "share", "label")


def luma_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as RGBA pixels of 16 a side of 4: the mean luma of every frame."""
    pixels = F.transform("embedding", lambda x: x.cast("double"))
    rows = sources.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), hashing.luma_image(pixels).alias("luma"))
    return rows.select("frame_id", six(F.aggregate("luma", F.lit(0.0), lambda a, x: a + x) / F.size("luma")).alias("mean_luma"))


def model_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first two logits of embeddings, those of even labels being clean, would do as a detector."""
    rows = sources.table(spark, sf_dir, "embeddings").select(F.slice(sources.class_logits(F.col("embedding")), 1, 2).alias("logits"), (F.col("label") % 2 == 0).alias("is_clean"))
    return detectors.fit_for_use(rows).select(six("swing").alias("swing"), six("ratio").alias("ratio"), "fit")


def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as updates that replace each other: the last one of every conversation."""
    rows = sources.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("role").alias("role"))
    return metrics.latest(rows, "conv_id", "turn")


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as devices: their keys say what a device has."""
    key = F.col("c_custkey")
    rows = sources.table(spark, sf_dir, "customer")
    return rows.select(
        F.col("c_custkey").alias("device_id"),
        device.usable_probe(F.when(key % 3 != 0, True)).alias("webgpu"),
        (key % 9 != 0).alias("gpu_present"),
        (key % 5 != 0).alias("webgl"),
        (key % 7 != 0).alias("wasm"),
        (key % 2 == 0).alias("webcodecs"),
        device.cores_of(F.when(key % 11 != 0, key % 17).cast("int")).alias("cores"),
        F.when(key % 4 != 0, key % 13).cast("double").alias("memory_gb"),
        (key % 6 == 0).alias("save_data"),
    )


def tier_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _devices(spark, sf_dir).withColumn("tier", device.tier(F.col("webgpu"), F.col("webgl"), F.col("cores"), F.col("memory_gb")))
    made = rows.withColumn("b", device.budget(F.col("tier"), F.col("save_data")))
    return made.select("device_id", "tier", *[F.col(f"b.{c}").alias(c) for c in ("survey_frames", "max_frames", "max_ms", "target_ms", "concurrency")])


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _devices(spark, sf_dir).withColumn("tier", device.tier(F.col("webgpu"), F.col("webgl"), F.col("cores"), F.col("memory_gb")))
    rows = rows.withColumn("backend", device.preferred_backend(F.col("webgpu"), F.col("webgl"), F.col("wasm")))
    described = device.describe(F.col("tier"), F.col("backend"), F.col("cores"), F.col("memory_gb"), F.col("webcodecs"))
    notes = device.notes(F.col("gpu_present"), F.col("webgpu"), F.col("webgl"), F.col("webcodecs"))
    return rows.select("device_id", described.alias("description"), F.array_join(device.backend_chain(F.col("backend")), ">").alias("chain"), F.array_join(notes, "; ").alias("notes"))


def governor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The medium budget of every video after the median of its values as inference times."""
    rows = sources.deliveries(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list(F.col("score") * 400)).alias("v"))
    b = BUDGETS["medium"]
    made = device.governed(F.lit(b.max_frames), F.lit(b.min_gap_ms), F.lit(b.target_ms), metrics.nearest_rank(F.col("v"), 0.5), F.size("v"))
    return rows.withColumn("g", made).select("video_id", "g.max_frames", "g.min_gap_ms", "g.throttled", six("g.factor").alias("factor"))


def resolution_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far duplicates (a second delivery within the same 100 ms) widen each video's gap."""
    slots = sources.deliveries(spark, sf_dir).groupBy("video_id", F.floor(F.col("ts_ms") / 100).alias("slot")).agg((F.count("*") - 1).alias("again"))
    rows = slots.groupBy("video_id").agg(F.sum("again").alias("duplicates"))
    return rows.select("video_id", "duplicates", device.resolution_floor(F.lit(250), F.col("duplicates"), F.lit(sources.DURATION_MS)).alias("floor_ms"))


def source_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: key and price say what they are."""
    key = F.col("o_orderkey")
    rows = sources.table(spark, sf_dir, "orders")
    size = F.when(key % 5 != 0, F.floor(F.col("o_totalprice") * 1000).cast("long"))
    kind = device.source_kind(F.col("o_orderstatus") != "P", size, key % 7 != 0, key % 3 != 0)
    return rows.select(F.col("o_orderkey").alias("file_id"), kind["kind"].alias("kind"), kind["reason"].alias("reason"))


def url_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.table(spark, sf_dir, "pages").select("page_id", device.accepts_url(F.col("url")).alias("accepted"))


def median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as container samples of a video, signups as keyframes."""
    rows = sources.frames(spark, sf_dir).select("video_id", "ts_ms", (F.col("arrival") % 90).alias("duration_ms"), (F.col("kind") == "signup").alias("is_sync"))
    stats = container.container_stats(rows)
    resolution = device.resolution_ms(F.col("frame_ms"), F.col("keyframe_gap_ms").cast("double"), F.col("keyframes"))
    gap = device.sampling_gap(F.lit(BUDGETS["medium"].min_gap_ms), resolution)
    return stats.select("video_id", "duration_ms", "keyframes", "frame_ms", "keyframe_gap_ms", resolution.alias("resolution_ms"), gap.alias("sampling_gap_ms"))


def random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each survey request is delivered with, signups being keyframes."""
    samples = sources.frames(spark, sf_dir).select("video_id", "ts_ms", (F.col("kind") == "signup").alias("is_sync"))
    return lookups.fetch(survey_plan(spark, sf_dir), samples)


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.selected(_videos(spark, sf_dir), sources.deliveries(spark, sf_dir), BUDGETS["medium"], arrival="arrival")


def refine_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that follow the survey of every video, best first."""
    made = _selected(spark, sf_dir).where("level > 0").drop("on_keyframe")
    return made.withColumns({"priority": six("priority"), "score": six("score"), "level": F.col("level").cast("long"), "place": F.col("place").cast("long")})


def snapped_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey requests on the keyframes (signups) nearest to them, none asked for twice."""
    return sampling.survey(_videos(spark, sf_dir), BUDGETS["medium"], sources.keyframes(spark, sf_dir))


def snapped_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests of every video, on keyframes (signups) where one is near; frames of error events can't be read."""
    rows = sources.deliveries(spark, sf_dir).withColumn("score", F.when(F.col("kind") != "error", F.col("score")))
    made = sampling.selected(_videos(spark, sf_dir), rows, BUDGETS["medium"], sources.keyframes(spark, sf_dir), arrival="arrival")
    return made.withColumns({"priority": six("priority"), "score": six("score"), "level": F.col("level").cast("long"), "place": F.col("place").cast("long")})


def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many requests each video gets, how many frames answer them, and how often a frame is delivered again."""
    return sampling.request_stats(_selected(spark, sf_dir))


def selected_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over the frames that survey and refinement choose."""
    chosen = _selected(spark, sf_dir).select("video_id", F.col("served_ms").alias("ts_ms"), "score", F.lit(sources.DURATION_MS).cast("long").alias("duration_ms")).distinct()
    rows = temporal.verdicts(chosen, BALANCED)
    return rows.select("video_id", "n_frames", six("max_score").alias("max_score"), six("coverage").alias("coverage"), "contains_inappropriate_content", "confidence")


def streaming_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last verdict that a stream over the events published for every video."""
    rows = sources.stream(spark, sf_dir).select("video_id", "ts_ms", "score", "arrival", "duration_ms")
    return progress.run(spark, rows, BALANCED)


def streaming_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restricted spans after a stream over the events, whose state is time buckets."""
    rows = sources.stream(spark, sf_dir).select("video_id", "ts_ms", "score", "arrival", "duration_ms")
    return progress.segments(rows, BALANCED).withColumn("peak_score", six("peak_score"))


def streaming_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms after a stream over the events."""
    rows = sources.event_stream(spark, sf_dir).select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), F.col("value").alias("ms"))
    return reservoirs.histograms(rows)


def scan_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of a scan: 16 survey requests first, errors fail, a purchase of more than 190 cancels what follows."""
    order = Window.partitionBy("video_id").orderBy("ts_ms", "arrival")
    rows = sources.deliveries(spark, sf_dir).withColumns({"step": F.row_number().over(order), "elapsed_ms": F.col("ts_ms") - F.min("ts_ms").over(Window.partitionBy("video_id"))})
    gone = F.lag((F.col("kind") == "purchase") & (F.col("score") > 190 / 400), 1, False).over(order)
    log = rows.withColumns({"survey": F.col("step") <= 16, "failed": F.col("kind") == "error", "cancelled": gone})
    return outcomes.outcomes(outcomes.recorded(log), Budget(max_frames=48, max_ms=200_000))


def queries() -> dict:
    plain = (
        what_if, segments, coverage, independent_flagged, topk_mean, early_exit, verdict_json, restricted_report, peak_category, merge_detectors, combine_categories, screened_sets, frame_score, dominant_class, softmax,
        detector_scan, merge_crops, hit_probability, frame_rate, report, dhash, near_dup_banded, near_hash_groups, perceptual_dedupe, first_delivered, survey_plan, survey_lookup, keyframe_asof, nearest_keyframe, range_mitigation, player_state, timer_histogram, throughput, counters,
        long_tasks, timeline_axis, luma_means, model_fitness, latest_progress, tier_budget, capabilities, governor, resolution_floor, source_decision, url_validation, median_gap, random_access, refine_plan, snapped_survey, snapped_refinement, scan_stats, selected_verdict, streaming_verdict, streaming_segments, streaming_histogram, scan_outcomes,
    )
    return {f"scan_verdict_{p}": partial(scan_verdict, p) for p in POLICIES} | {f.__name__: f for f in plain}


def oracle_sql() -> dict[str, str]:
    return sql.all_queries()
