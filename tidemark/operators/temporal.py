"""Per-video temporal aggregation: coverage, independent evidence, verdicts, segments and category peaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import EARLY_EXIT_MARGIN, EARLY_EXIT_SINGLE, MERGE_GAP_MS, PAD_MS, TOP_K, VOUCH_RADIUS_MS, Policy
from tidemark.functions.scoring import clamp01, negative_confidence, positive_confidence, round_to
from tidemark.operators.buckets import BUCKET, bucketed


def coverage(frames: DataFrame, radius: int = VOUCH_RADIUS_MS) -> DataFrame:
    """video_id, coverage: the share of the video that lies within the radius of a sample, each gap shared by its two ends.

    Gaps within a time bucket are summed there, those between buckets over one row per bucket.
    """
    ts = F.col("ts_ms")
    gap = lambda apart: F.when(apart.isNotNull(), F.least(F.lit(2 * radius).cast("long"), apart))
    inside = gap(ts - F.lag("ts_ms").over(Window.partitionBy("video_id", BUCKET).orderBy("ts_ms")))
    parts = bucketed(frames).withColumn("_gap", inside).groupBy("video_id", BUCKET)
    parts = parts.agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"), F.sum("_gap").alias("gaps"), F.max("duration_ms").alias("d"))
    between = gap(F.col("first") - F.lag("last").over(Window.partitionBy("video_id").orderBy(BUCKET)))
    whole = parts.withColumn("_between", between).groupBy("video_id")
    whole = whole.agg((F.coalesce(F.sum("gaps"), F.lit(0)) + F.coalesce(F.sum("_between"), F.lit(0))).alias("gaps"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("d").alias("d"))
    end = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(float(radius)), x.cast("double")))
    held = F.col("gaps") + end(F.col("first")) + end(F.col("d") - F.col("last"))
    return whole.select("video_id", F.when(F.col("d") > 0, clamp01(held / F.col("d"))).otherwise(F.lit(0.0)).alias("coverage"))


def independent(times: Column, gap_ms: int) -> Column:
    """How many of the times (an array) are evidence of their own: from each that counts, the next is at least the gap away."""
    if gap_ms <= 0:
        return F.size(times).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("anchor"))
    return F.aggregate(
        F.array_sort(times),
        start,
        lambda a, t: F.when(
            a["anchor"].isNull() | (t - a["anchor"] >= gap_ms), F.struct((a["n"] + 1).alias("n"), t.cast("long").alias("anchor"))
        ).otherwise(a),
        lambda a: a["n"],
    )


class Islands:
    """Independent evidence under a rule (name, threshold, gap_ms) without gathering the flagged frames.

    A flagged frame at least the gap after the flagged one before it always counts, whatever was counted earlier: it begins an
    island. Of the others of its island only those at least the gap after its beginning may count, and none of them is within
    the gap of another island's. So beginnings are counted, and only such late frames are folded, in order: their times are all
    that is gathered of a video.
    """

    def __init__(self, name: str, threshold: float, gap_ms: int):
        self.name, self.gap = name, gap_ms
        self.flagged = F.col("score") >= threshold
        self.begins, self.late = f"_begins_{name}", f"_late_{name}"

    @staticmethod
    def marked(frames: DataFrame, rules: Sequence[Islands]) -> DataFrame:
        """frames with the marks of all rules; one order by video and time serves all of them."""
        order, ts = Window.partitionBy("video_id").orderBy("ts_ms"), F.col("ts_ms").cast("long")
        gapped = [r for r in rules if r.gap > 0]
        before = {f"_before_{r.name}": F.max(F.when(r.flagged, ts)).over(order.rowsBetween(Window.unboundedPreceding, -1)) for r in gapped}
        begins = {r.begins: F.when(r.flagged & F.coalesce(ts - F.col(f"_before_{r.name}") >= r.gap, F.lit(True)), ts) for r in gapped}
        late = {r.late: F.when(r.flagged & (ts - F.max(r.begins).over(order.rowsBetween(Window.unboundedPreceding, 0)) >= r.gap), ts) for r in gapped}
        return frames.withColumns(before).withColumns(begins).withColumns(late).drop(*before) if gapped else frames

    def count(self) -> Column:
        """Over the marked frames of a video."""
        if self.gap <= 0:
            return F.count_if(self.flagged)
        return F.count(self.begins) + independent(F.collect_list(self.late), self.gap)


def independents(frames: DataFrame, rules: Sequence[tuple[str, float, int]]) -> DataFrame:
    """video_id, and per rule (name, threshold, gap_ms) how many of the video's flagged frames are evidence of their own."""
    islands = [Islands(*rule) for rule in rules]
    some = frames.where(F.col("score") >= min(threshold for _, threshold, _ in rules))
    return Islands.marked(some, islands).groupBy("video_id").agg(*[i.count().alias(i.name) for i in islands])


def top_mean(frames: DataFrame, k: int = TOP_K) -> DataFrame:
    """video_id, topk_mean: the mean of the k highest scores."""
    order = Window.partitionBy("video_id").orderBy(F.desc("score"), "ts_ms")
    best = frames.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    return best.groupBy("video_id").agg(F.avg("score").alias("topk_mean"))


def _gathered(frames: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """One row per video: what verdicts rest on, and per policy the numbers of its flagged and its independent flagged frames.

    Frames meet by video once: the windows and the aggregation share that partitioning.
    """
    order = Window.partitionBy("video_id").orderBy("ts_ms")
    ts, before, after = F.col("ts_ms"), F.lag("ts_ms").over(order), F.lead("ts_ms").over(order)
    reach = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(float(VOUCH_RADIUS_MS)), x))
    held = reach(F.coalesce((ts - before) / 2.0, ts.cast("double"))) + reach(F.coalesce((after - ts) / 2.0, (F.col("duration_ms") - ts).cast("double")))
    best = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "ts_ms")) <= TOP_K
    islands = [Islands(f"_n_{p.id}", p.frame_threshold, p.gap_ms) for p in policies]
    return (
        Islands.marked(frames.withColumn("_held", held), islands)
        .withColumn("_best", best)
        .groupBy("video_id")
        .agg(
            F.count("*").alias("n_frames"),
            F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score"),
            F.avg(F.when(F.col("_best"), F.col("score"))).alias("topk_mean"),
            F.sum("_held").alias("_held"),
            F.max("duration_ms").alias("_d"),
            *[F.count_if(F.col("score") >= p.frame_threshold).alias(f"_flagged_{p.id}") for p in policies],
            *[i.count().alias(i.name) for i in islands],
        )
        .withColumn("coverage", F.when(F.col("_d") > 0, clamp01(F.col("_held") / F.col("_d"))).otherwise(F.lit(0.0)))
        .drop("_held", "_d")
    )


def evidence(frames: DataFrame, policy: Policy) -> DataFrame:
    """One row per video: n_frames, max_score, topk_mean, coverage, flagged, independent."""
    return _gathered(frames, [policy]).withColumnsRenamed({f"_flagged_{policy.id}": "flagged", f"_n_{policy.id}": "independent"})


def positive(policy: Policy, count: Column | None = None) -> Column:
    count = F.col("independent") if count is None else count
    return (F.col("n_frames") > 0) & ((count >= policy.min_flagged) | (F.col("max_score") >= policy.single_threshold))


def confidence(policy: Policy, count: Column | None = None) -> Column:
    count = F.col("independent") if count is None else count
    sure = positive_confidence(F.col("topk_mean"), count, policy)
    return round_to(F.when(positive(policy, count), sure).otherwise(negative_confidence(F.col("max_score"), F.col("coverage"), policy)), 2)


def verdicts(frames: DataFrame, policy: Policy) -> DataFrame:
    """evidence with contains_inappropriate_content and confidence."""
    return evidence(frames, policy).withColumn("contains_inappropriate_content", positive(policy)).withColumn("confidence", confidence(policy))


def verdicts_under(frames: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """video_id, policy, contains_inappropriate_content, confidence: all policies in one pass over the frames."""
    rows = _gathered(frames, policies)
    each = [
        F.struct(F.lit(p.id).alias("policy"), positive(p, F.col(f"_n_{p.id}")).alias("contains_inappropriate_content"), confidence(p, F.col(f"_n_{p.id}")).alias("confidence"))
        for p in policies
    ]
    return rows.select("video_id", F.inline(F.array(*each)))


def early_exit(policy: Policy) -> Column:
    """On evidence: whether more frames could hardly change a positive verdict."""
    alone = F.col("max_score") >= max(policy.single_threshold, EARLY_EXIT_SINGLE)
    many = (F.col("independent") >= max(2, policy.min_flagged)) & (F.col("topk_mean") >= policy.frame_threshold + EARLY_EXIT_MARGIN)
    return positive(policy) & (alone | many)


def segments(frames: DataFrame, policy: Policy, merge_gap: int = MERGE_GAP_MS, pad: int = PAD_MS) -> DataFrame:
    """video_id, segment (from 1), start_ms, end_ms, peak_score, peak_ts_ms of restricted spans.

    Flagged frames at most merge_gap apart are one span, which is padded within the video and not merged again.
    """
    flagged = bucketed(frames.where(F.col("score") >= policy.frame_threshold))
    inside = Window.partitionBy("video_id", BUCKET).orderBy("ts_ms")
    new = F.coalesce(F.col("ts_ms") - F.lag("ts_ms").over(inside) > merge_gap, F.lit(True))
    numbered = flagged.withColumn("_new", new.cast("long")).withColumn("run", F.sum("_new").over(inside))
    peak = F.max(F.struct("score", (-F.col("ts_ms")).alias("t")))
    runs = numbered.groupBy("video_id", BUCKET, "run").agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"), F.max("duration_ms").alias("d"), peak.alias("p"))
    return joined_runs(runs, merge_gap, pad)


def joined_runs(runs: DataFrame, merge_gap: int = MERGE_GAP_MS, pad: int = PAD_MS) -> DataFrame:
    """Segments from runs of flagged frames within time buckets (video_id, first, last, d, p: peak score and -time).

    Of a video only as many rows as it has runs are put in order.
    """
    across = Window.partitionBy("video_id").orderBy("first")
    new = F.coalesce(F.col("first") - F.lag("last").over(across) > merge_gap, F.lit(True))
    joined = runs.withColumn("_new", new.cast("long")).withColumn("segment", F.sum("_new").over(across))
    spans = joined.groupBy("video_id", "segment").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("d").alias("d"), F.max("p").alias("p"))
    end = F.col("last") + pad
    return spans.select(
        "video_id",
        "segment",
        F.greatest(F.lit(0).cast("long"), F.col("first") - pad).alias("start_ms"),
        F.when(F.col("d") > 0, F.least(end, F.col("d"))).otherwise(end).alias("end_ms"),
        F.col("p.score").alias("peak_score"),
        (-F.col("p.t")).alias("peak_ts_ms"),
    )


def category_peaks(frames: DataFrame, key: str = "video_id") -> DataFrame:
    """key, category, peak, place (1: the driver of the verdict): highest first, then by name; NaN and absent scores are no evidence."""
    rows = frames.select(key, F.explode("categories").alias("category", "score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    peaks = rows.groupBy(key, "category").agg(F.greatest(F.lit(0.0), F.max("score")).alias("peak"))
    return peaks.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("peak"), "category")).cast("long"))


def verdict_json(rows: DataFrame) -> Column:
    """The two keys of a published verdict."""
    return F.to_json(F.struct("contains_inappropriate_content", "confidence"))
