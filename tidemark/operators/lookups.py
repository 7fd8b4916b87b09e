"""Lookups in time: backward as-of, nearest within a tolerance, keyframes without asking for one twice, and containment in spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import GOP_WALK, SPAN_LEAD_MS
from tidemark.functions.scoring import half_up
from tidemark.operators.buckets import BUCKET_MS, bucket_of


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, out: str, also: tuple[str, ...] = (), width: int = BUCKET_MS) -> DataFrame:
    """left with out: the last right time at or before left's, else the first one after; null where the key has none.

    also: further columns of that right row. Both sides meet by key and time bucket and are laid in one order there, behind
    a row that the bucket is handed: the last right row before it, or the key's first one. So a key of a third of all rows is as many
    groups as it has buckets, and what is ordered by key alone is one row per bucket.
    """
    row = F.struct(F.col(right_ts).cast("long").alias("_at"), *[F.col(c).alias(f"_{c}") for c in also])
    rights = right.where(F.col(right_ts).isNotNull()).select(F.col(key), F.col(right_ts).alias("_t"), F.lit(1).alias("_side"), row.alias("_r")).withColumn("_b", bucket_of(F.col("_t"), width))
    lefts = left.select("*", F.col(left_ts).alias("_t"), F.lit(2).alias("_side"), bucket_of(F.col(left_ts), width).alias("_b"))
    asked = lefts.select(key, "_b", F.lit(None).alias("_r"), F.lit(None).alias("_first")).unionByName(rights.select(key, "_b", "_r", F.struct("_t", "_r").alias("_first")))
    ends = asked.groupBy(key, "_b").agg(F.max_by("_r", "_r._at").alias("_last"), F.min_by("_first", "_first._t").alias("_first"))
    whole = Window.partitionBy(key)
    before = F.last("_last", ignorenulls=True).over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    first = F.min_by("_first._r", "_first._t").over(whole)
    handed = ends.select(key, "_b", F.lit(0).alias("_side"), F.coalesce(before, first).alias("_r"))
    laid = lefts.unionByName(rights, allowMissingColumns=True).unionByName(handed, allowMissingColumns=True)
    carried = F.last("_r", ignorenulls=True).over(Window.partitionBy(key, "_b").orderBy(F.when(F.col("_side") > 0, F.col("_t")).asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0))
    found = laid.withColumn("_r", carried).where("_side = 2")
    return found.withColumns({out: F.col("_r._at")} | {c: F.col(f"_r._{c}") for c in also}).drop("_t", "_side", "_b", "_r")


def fetch(requests: DataFrame, samples: DataFrame, walk: int = GOP_WALK) -> DataFrame:
    """requests (video_id, ts_ms) with served_ms and on_keyframe: what random access delivers.

    The last sample (video_id, ts_ms, is_sync) at or before the request (the first one, if none is) is decoded from the last keyframe at or
    before it; if that is more than `walk` samples away, the keyframe itself is served. Without any keyframe the first
    sample counts as one; a sample before the first keyframe is served as it is.
    """
    order, whole = Window.partitionBy("video_id").orderBy("ts_ms"), Window.partitionBy("video_id")
    numbered = samples.withColumn("n", F.row_number().over(order)).withColumn("key", F.col("is_sync") | (~F.max("is_sync").over(whole) & (F.col("n") == 1)))
    key = F.last(F.when(F.col("key"), F.struct("n", "ts_ms")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    far = F.coalesce(F.col("n") - F.col("k.n") > walk, F.lit(False))
    ready = numbered.withColumn("k", key).select("video_id", "ts_ms", F.when(far, F.col("k.ts_ms")).otherwise(F.col("ts_ms")).alias("served_ms"), (far | F.col("key")).alias("on_keyframe"))
    return as_of(requests, ready, "video_id", "ts_ms", "ts_ms", "_sample_ms", also=("served_ms", "on_keyframe")).drop("_sample_ms")


def nearest(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, out: str, tolerance: int) -> DataFrame:
    """left with out: the closest right time within the tolerance, the earlier one on a tie, else null."""
    both = left.select("*", F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_r")).unionByName(
        right.select(key, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(right_ts).cast("long").alias("_r")), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy("_t", "_side")
    back = F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_r", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = lambda c: F.when(F.abs(F.col(c) - F.col("_t")) <= tolerance, F.col(c))
    marked = both.withColumn("_back", back).withColumn("_ahead", ahead).where("_side = 1").withColumn("_b", near("_back")).withColumn("_a", near("_ahead"))
    closer = F.when(F.col("_b").isNull() | (F.col("_a") - F.col("_t") < F.col("_t") - F.col("_b")), F.coalesce("_a", "_b")).otherwise(F.col("_b"))
    return marked.withColumn(out, closer).drop("_t", "_side", "_r", "_back", "_ahead", "_a", "_b")


def snapped(requests: DataFrame, keyframes: DataFrame, tolerance: str = "tolerance") -> DataFrame:
    """requests (video_id, at: double ms, a tolerance) with ts_ms and on_keyframe, in the order of time, without those that ask for a time again.

    A request goes to the nearest of the keyframes (video_id, kf_ms) around it, the one before, at or after it and the next,
    that is within its tolerance and that no earlier request of the video has, the earlier one on a tie; else to its own time,
    rounded. Requests that could want the same time are chains, in which each depends on those before: a chain is folded in order,
    and it ends where all that later requests could want lies behind what it could have.
    """
    order, per = Window.partitionBy("video_id").orderBy("kf_ms"), Window.partitionBy("video_id").orderBy("at")
    row = keyframes.select("video_id", "kf_ms").where("kf_ms IS NOT NULL").distinct()
    row = row.select("video_id", "kf_ms", F.lag("kf_ms").over(order).alias("_back"), F.lead("kf_ms").over(order).alias("_next"), F.lead("kf_ms", 2).over(order).alias("_later"))
    found = as_of(requests, row, "video_id", "at", "kf_ms", "_kf", also=("_back", "_next", "_later"))
    last, exact, ahead = F.col("_next").isNull() & (F.col("_kf") < F.col("at")), F.col("_kf") == F.col("at"), F.col("_kf") > F.col("at")
    around = (
        F.when(F.col("_kf").isNull(), F.array())
        .when(ahead, F.array("_kf", "_next"))
        .when(exact, F.array("_back", "_kf", "_next"))
        .when(last, F.array("_back", "_kf"))
        .otherwise(F.array("_kf", "_next", "_later"))
    )
    near = F.filter(around, lambda k: k.isNotNull() & (F.abs(k - F.col("at")) <= F.col(tolerance)) & (F.col(tolerance) > 0))
    ranked = F.transform(near, lambda k: F.struct(F.abs(k - F.col("at")).alias("far"), k.cast("long").alias("kf")))
    own = half_up(F.col("at"))
    asked = found.withColumns({"_own": own, "_near": F.transform(F.array_sort(ranked), lambda x: x["kf"])})
    least, most = F.least(F.coalesce(F.array_min("_near"), own), own), F.greatest(F.coalesce(F.array_max("_near"), own), own)
    apart = F.coalesce(least > F.max(most).over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    chains = asked.withColumn("_chain", apart.cast("long")).withColumn("_chain", F.sum("_chain").over(per))
    columns = [c for c in requests.columns if c != "video_id"]
    whole = F.struct("at", "_own", "_near", F.struct(*columns).alias("_row"))
    folded = chains.groupBy("video_id", "_chain").agg(F.array_sort(F.collect_list(whole)).alias("_all"))

    def take(taken: F.Column, x: F.Column) -> F.Column:
        free = F.filter(x["_near"], lambda k: ~F.array_contains(taken, k))
        return F.concat(taken, F.array(F.coalesce(F.get(free, F.lit(0)), x["_own"])))

    times = F.aggregate("_all", F.array().cast("array<long>"), take)
    each = folded.select("video_id", F.posexplode(F.arrays_zip(F.col("_all").alias("x"), times.alias("ts_ms"))).alias("_at", "z"), times.alias("_times"))
    first = F.array_position("_times", F.col("z.ts_ms")) == F.col("_at") + 1
    return each.where(first).select("video_id", "z.x._row.*", "z.ts_ms", (F.col("z.ts_ms") != F.col("z.x._own")).alias("on_keyframe"))


def in_spans(points: DataFrame, spans: DataFrame, key: str, ts: str, bucket_ms: int = 4000, lead: int = SPAN_LEAD_MS) -> DataFrame:
    """The points within [start_ms - lead, end_ms] of a span of their key, each once.

    A span is laid into the time buckets it touches, so that the join is on (key, bucket) whatever the spans' lengths.
    """
    laid = spans.select(
        F.col(key).alias("_k"),
        (F.col("start_ms") - lead).alias("_from"),
        F.col("end_ms").alias("_to"),
        F.explode(F.sequence(F.floor((F.col("start_ms") - lead) / bucket_ms), F.floor(F.col("end_ms") / bucket_ms))).alias("_bucket"),
    )
    on = (F.col(key) == F.col("_k")) & (F.floor(F.col(ts) / bucket_ms) == F.col("_bucket")) & F.col(ts).between(F.col("_from"), F.col("_to"))
    return points.join(laid, on, "left_semi")
