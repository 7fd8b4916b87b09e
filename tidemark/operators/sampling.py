"""Which times of a video to look at: an even survey, then halves of the widest and most suspicious intervals.

Refinement is a tree of halved intervals per video. An interval's rank is the suspicion of its ends times the logarithm of its
width, and none is halved before the interval that it came from: its rank is the least on the way down from the survey. So
halvings are asked for in the order of rank, best first, and the order doesn't depend on what is asked for later.

Every request depends on the answers to those before it. So a video's length, keyframes and frames meet once, in one shuffle, and
stream past in the order of video and time. A task takes some hundred videos at once, so that each step is
one of arrays, and looks up what their budgets could ask for. It holds ROWS rows or one video's, of at most one frame a millisecond.

A request whose frame could not be read (its score is null) fails: a survey's is no end of an interval, and a halving's two
halves keep the score of the end that they have. Neither counts as a frame.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import BASE_PRIORITY, Budget
from tidemark.functions.scoring import half_up
from tidemark.operators.lookups import as_of, snapped

#: What the rows of a video are, in their order: its length, keyframes, frames, and requests with an answer.
LENGTH, KEYFRAME, FRAME, ANSWERED = range(4)
#: No request's time.
NEVER = np.iinfo(np.int64).min
#: Rows of videos that a task takes at once, about.
ROWS = 60_000


def cells(videos: DataFrame, budget: Budget) -> DataFrame:
    """videos (video_id, duration_ms > 0) -> video_id, slot, at: the centres of equal cells, however long the video is; tolerance: half a cell."""
    most = F.greatest(F.lit(1).cast("long"), F.floor(F.col("duration_ms") / budget.min_gap_ms))
    n = F.greatest(F.lit(1).cast("long"), F.least(F.lit(budget.survey_frames).cast("long"), most, F.lit(budget.max_frames).cast("long")))
    laid = videos.where("duration_ms > 0").withColumn("n", n).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    wide = F.col("duration_ms") / F.col("n").cast("double")
    return laid.select("video_id", "slot", ((F.col("slot") + F.lit(0.5)) * wide).alias("at"), (wide * 0.5).alias("tolerance"))


def survey(videos: DataFrame, budget: Budget, keyframes: DataFrame | None = None) -> DataFrame:
    """video_id, slot, ts_ms, and with keyframes (video_id, kf_ms) on_keyframe: cells' centres, or the free keyframes nearest to them within their cell."""
    asked = cells(videos, budget)
    if keyframes is None:
        return asked.select("video_id", "slot", half_up(F.col("at")).alias("ts_ms")).dropDuplicates(["video_id", "ts_ms"])
    return snapped(asked, keyframes).select("video_id", "slot", "ts_ms", "on_keyframe")


def served(requests: DataFrame, frames: DataFrame) -> DataFrame:
    """requests (video_id, ts_ms) with served_ms and score of the frame (video_id, ts_ms, score) that answers each."""
    return as_of(requests, frames, "video_id", "ts_ms", "ts_ms", "served_ms", also=("score",))


def ranks(width: np.ndarray, x: np.ndarray, y: np.ndarray, gap: int) -> np.ndarray:
    """Of intervals with scores x and y at their ends. math.log2 and not numpy's, whose last digit may differ from SQL's."""
    wide = np.array([math.log2(w) for w in (1 + width / gap).tolist()])
    rank = np.floor((BASE_PRIORITY + np.maximum(x, y)) * wide * 1e9 + 0.5) / 1e9
    if not np.isfinite(rank).all():
        raise ValueError("scores must be finite")
    return rank


def _keyed(video: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Complex numbers are ordered by their real, then by their imaginary part; times are below 2 ** 53."""
    made = np.empty(len(t), complex)
    made.real, made.imag = video, t
    return made


class Times:
    """Times of many videos: those of video k are at[cuts[k]:cuts[k + 1]], rising."""

    def __init__(self, at: np.ndarray, video: np.ndarray, videos: int):
        self.at, self.cuts, self.keyed = at, np.searchsorted(video, np.arange(videos + 1)), _keyed(video, at)

    def upto(self, video: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Where the video's times after t begin."""
        return np.searchsorted(self.keyed, _keyed(video, t), "right")


def _snap(v: np.ndarray, at: np.ndarray, own: np.ndarray, reach: np.ndarray, keys: Times, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest keyframe around each time at, within its reach and not among the video's taken ones (a row a video), else own; and whether it is another time than own."""
    low, high = keys.cuts[v], keys.cuts[v + 1]
    if not len(keys.at):
        return own, np.zeros(len(v), bool)
    near = np.minimum(keys.upto(v, np.ceil(at).astype(np.int64) - 1), high - 1)[:, None] + np.arange(-1, 2)  # behind all keyframes the last two are asked
    key = keys.at[np.clip(near, 0, len(keys.at) - 1)]
    far = np.abs(key - at[:, None])
    free = (near >= low[:, None]) & (near < high[:, None]) & (far <= reach[:, None]) & ~(key[:, :, None] == taken[v][:, None, :]).any(2)
    best = np.argmin(np.where(free, far, np.inf), 1)
    rows = np.arange(len(v))
    ts = np.where(free[rows, best], key[rows, best], own)
    return ts, ts != own


def _surveyed(duration: np.ndarray, keys: Times, budget: Budget) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`survey` of many videos at once, one cell of all of them after the other: video, ts, on_keyframe, in the order of video and time."""
    most = np.maximum(1, np.minimum(np.maximum(1, duration // budget.min_gap_ms), min(budget.survey_frames, budget.max_frames)))
    n = np.where(duration > 0, most, 0)
    taken, made = np.full((len(n), int(n.max(initial=0))), NEVER), []
    for k in range(taken.shape[1]):
        v = np.flatnonzero(n > k)
        wide = duration[v] / n[v]
        at = (k + 0.5) * wide
        ts, key = _snap(v, at, np.floor(at + 0.5).astype(np.int64), wide * 0.5, keys, taken)
        new = ~(ts[:, None] == taken[v]).any(1)
        taken[v, k] = ts
        made.append((v[new], ts[new], key[new]))
    v, ts, key = (np.concatenate(c) for c in zip(*made, strict=True)) if made else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    order = np.lexsort((ts, v))
    return v[order], ts[order], key[order]


def _within(flags: np.ndarray, begins: np.ndarray, video: np.ndarray) -> np.ndarray:
    """How many flags of its video are before each row; begins: each video's first row."""
    before = np.cumsum(flags) - flags
    return before - before[np.minimum(begins, len(flags) - 1)][video] if len(flags) else before


def best_first(sound: dict, duration: np.ndarray, keys: Times, failed: np.ndarray, answer: Callable, budget: Budget) -> dict:
    """The requests that follow the surveys of many videos, best first: v, place (from 1), ts, level (from 1), q (the rank), key, served, score, lost.

    sound: v, ts, score of the answers that could be read, in the order of video and time; failed: the other times, a row a video.
    Of equal ranks the upper level is first, then the earlier interval. An interval narrower than two gaps isn't halved. It is
    halved at the keyframe nearest to its middle within a quarter of its width that is not failed, else at its middle, rounded.

    All videos go on together, in waves. A wave asks of a video as many of the first intervals that wait as it could ask if each
    were answered (and an eighth of what it asked, as many may fail). What turns out to lie behind the last frame of the budget,
    as halves of others come before it, is left out again; halves are never before what they come from, so nothing else is.
    """
    gap, videos = budget.min_gap_ms, len(duration)
    v, ts, score = sound["v"], sound["ts"], sound["score"]
    count = np.bincount(v, minlength=videos)
    room = budget.max_frames - count
    nth, last = np.cumsum(count > 0)[v] - 1, np.diff(v, append=-1) != 0  # of n answers there are n + 1 intervals: from 0, between them, to the end
    ends, starts = np.arange(len(v)) + nth, np.arange(len(v)) + nth + 1
    a, b, of = np.zeros(len(v) + int(last.sum()), np.int64), np.zeros(len(v) + int(last.sum()), np.int64), np.zeros(len(v) + int(last.sum()), np.int64)
    x, y = np.zeros(len(a)), np.zeros(len(a))
    of[ends], of[starts], b[ends], a[starts], y[ends], x[starts] = v, v, ts, ts, score, score
    b[starts[last]], y[starts[last]] = duration[v[last]], score[last]
    first = np.diff(v, prepend=-1) != 0
    x[ends[first]] = score[first]

    def waits(v, a, b, x, y, bound, level) -> dict:
        wide = b - a >= 2 * gap
        v, a, b, x, y, bound, level = (c[wide] for c in (v, a, b, x, y, bound, level))
        return {"v": v, "a": a, "b": b, "x": x, "y": y, "level": level, "q": np.minimum(bound, ranks(b - a, x, y, gap))}

    waiting = waits(of, a, b, x, y, np.full(len(a), np.inf), np.ones(len(a), np.uint8))
    none = np.zeros(0, np.int64)
    done = {"v": none, "a": none, "level": none.astype(np.uint8), "q": np.zeros(0), "ts": none, "key": none.astype(bool), "served": none, "score": np.zeros(0), "lost": none.astype(bool)}
    small = np.min_scalar_type(videos)
    while True:
        v, a, level, q = (np.concatenate([done[c], waiting[c]]) for c in ("v", "a", "level", "q"))
        asked = np.arange(len(v)) < len(done["v"])
        order = np.lexsort((a, level, -q, v.astype(small)))
        v, at, asked = v[order], np.where(asked, np.arange(len(v)), np.arange(len(v)) - len(done["v"]))[order], asked[order]
        counts = asked.copy()
        counts[asked] = ~done["lost"][at[asked]]
        begins = np.searchsorted(v, np.arange(videos))
        recorded = _within(counts.astype(np.int64), begins, v)
        alive = recorded < room[v]
        done = {c: x[at[asked & alive]] for c, x in done.items()}
        waits_here = alive & ~asked
        if not waits_here.any():
            place = _within(np.ones(len(done["v"]), np.int64), np.searchsorted(done["v"], np.arange(videos)), done["v"]) + 1
            return done | {"place": place}
        most = room + np.bincount(done["v"], minlength=videos) // 8
        now = waits_here & (recorded + _within((~asked).astype(np.int64), begins, v) < most[v])
        ask, waiting = {c: x[at[now]] for c, x in waiting.items()}, {c: x[at[waits_here & ~now]] for c, x in waiting.items()}
        a, b = ask["a"], ask["b"]
        ts, key = _snap(ask["v"], (a + b) / 2, (a + b + 1) // 2, (b - a) / 4, keys, failed)
        again = (ts[:, None] == failed[ask["v"]]).any(1)
        ask, ts, key = {c: x[~again] for c, x in ask.items()}, ts[~again], key[~again]
        served, score, lost = answer(ask["v"], ts)
        done = {c: np.concatenate([x, y]) for (c, x), y in zip(done.items(), (ask["v"], ask["a"], ask["level"], ask["q"], ts, key, served, score, lost), strict=True)}
        left, right = (ask["a"], ts, ask["x"], np.where(lost, ask["x"], score)), (ts, ask["b"], np.where(lost, ask["y"], score), ask["y"])
        halves = waits(np.tile(ask["v"], 2), *(np.concatenate(c) for c in zip(left, right, strict=True)), np.tile(ask["q"], 2), np.tile(ask["level"] + np.uint8(1), 2))
        waiting = {c: np.concatenate([x, halves[c]]) for c, x in waiting.items()}


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A stream in the order of videos as tables of whole videos, of ROWS rows or one video's and a batch more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        video = batch.column("video_id")
        ends = pc.run_end_encode(video).run_ends
        cut = ends[-2].as_py() if len(ends) > 1 else 0
        if sum(x.num_rows for x in held) + cut >= ROWS and (cut or held[-1].column("video_id")[-1].as_py() != video[0].as_py()):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _requests(group: pa.Table, budget: Budget, survey: bool) -> dict:
    """The requests of whole videos, whose rows are in the order of video, side and time: with survey its own (level 0), and `best_first`. As columns."""
    runs = pc.run_end_encode(group.column("video_id").combine_chunks())
    videos, video = len(runs.values), np.repeat(np.arange(len(runs.values)), np.diff(runs.run_ends.to_numpy(), prepend=0))
    side, ts, score = (group.column(c).to_numpy() for c in ("side", "ts_ms", "score"))
    unread = group.column("score").is_null().to_numpy()
    of, key, frame, given = (np.flatnonzero(side == s) for s in (LENGTH, KEYFRAME, FRAME, ANSWERED))
    times = Times(ts[frame], video[frame], videos)
    frame = np.append(frame, -1)  # what is found of a video without frames

    def answer(v: np.ndarray, t: np.ndarray) -> tuple:
        low, high = times.cuts[v], times.cuts[v + 1]
        at = frame[np.where(low < high, np.maximum(low, times.upto(v, t) - 1), -1)]
        return np.where(at < 0, -1, ts[at]), score[at], (at < 0) | unread[at]

    duration, known = np.zeros(videos, np.int64), np.zeros(videos, bool)
    duration[video[of[::-1]]], known[video[of]] = ts[of[::-1]], True
    fresh = key[np.diff(video[key], prepend=-1).astype(bool) | np.diff(ts[key], prepend=0).astype(bool)]
    keys = Times(ts[fresh], video[fresh], videos)
    asked, wanted, on_keyframe = _surveyed(duration if survey else np.zeros(videos, np.int64), keys, budget)
    served, found, lost = answer(asked, wanted)
    v, t, x, no = (np.concatenate(c) for c in ((video[given], asked), (ts[given], wanted), (score[given], found), (unread[given], lost)))
    order = np.argsort(v, kind="stable")
    v, t, x, no = v[order], t[order], x[order], no[order]
    sound, bad = ~no & known[v], np.flatnonzero(no)
    nth = _within(np.ones(len(bad), np.int64), np.searchsorted(v[bad], np.arange(videos)), v[bad])
    failed = np.full((videos, int(nth.max(initial=-1)) + 1), NEVER)
    failed[v[bad], nth] = t[bad]
    made = best_first({"v": v[sound], "ts": t[sound], "score": x[sound]}, duration, keys, failed, answer, budget)
    first = np.arange(len(asked) + len(made["v"])) < len(asked)
    both = lambda x, y: np.concatenate([x, y])
    blank, lost = np.zeros(len(asked)), both(lost, made["lost"])
    of = both(asked, made["v"])
    return {
        "video_id": runs.values.take(pa.array(of)),
        "place": pa.array(both(blank, made["place"]).astype(np.int32), mask=first),
        "ts_ms": pa.array(both(wanted, made["ts"])),
        "level": pa.array(both(blank, made["level"]).astype(np.int32)),
        "priority": pa.array(both(blank, made["q"]), mask=first),
        "on_keyframe": pa.array(both(on_keyframe, made["key"])),
        "served_ms": pa.array(both(served, made["served"]), mask=times.cuts[of] == times.cuts[of + 1]),
        "score": pa.array(both(found, made["score"]), mask=lost),
    }


def _searched(videos: DataFrame, answers: DataFrame | None, frames: DataFrame, budget: Budget, keyframes: DataFrame | None, arrival: str | None = None) -> DataFrame:
    """What `_requests` gives for each video, with video_id; without answers (video_id, ts_ms, score) it begins with the survey."""
    kind = videos.schema["video_id"].dataType.simpleString()
    rising = ["video_id", "side", "ts_ms"]

    def rows(of: DataFrame, side: int, ts: str) -> DataFrame:
        own = F.col("score").cast("double") if side >= FRAME else F.lit(None).cast("double")
        nth = [F.col(arrival).alias("nth") if side == FRAME else F.lit(None).cast(frames.schema[arrival].dataType).alias("nth")] if arrival else []
        return of.where(F.col(ts).isNotNull()).select("video_id", F.lit(side).alias("side"), F.col(ts).cast("long").alias("ts_ms"), own.alias("score"), *nth)

    laid = rows(videos, LENGTH, "duration_ms").unionByName(rows(frames, FRAME, "ts_ms"))
    if answers is not None:
        laid = laid.unionByName(rows(answers, ANSWERED, "ts_ms"))
    if keyframes is not None:
        laid = laid.unionByName(rows(keyframes, KEYFRAME, "kf_ms"))

    survey = answers is None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            yield pa.RecordBatch.from_pydict(_requests(group, budget, survey))

    # by a hash of the video: where all inputs are dealt by video already, Spark leaves out a repartition by it, and then merges their partitions one by one;
    # with a number: a search takes far longer than its few bytes let adaptive execution expect, which else merges what it deals to one or two tasks
    dealt = laid.withColumn("deal", F.xxhash64("video_id")).repartition(int(laid.sparkSession.conf.get("spark.sql.shuffle.partitions")), "deal")
    if arrival:
        first = F.row_number().over(Window.partitionBy("deal", *rising).orderBy("nth"))
        dealt = dealt.withColumn("_n", first).where("_n = 1")
    whole = dealt.sortWithinPartitions("deal", *rising).select(*rising, "score")
    return whole.mapInArrow(task, f"video_id {kind}, place int, ts_ms long, level int, priority double, on_keyframe boolean, served_ms long, score double")


def refine(videos: DataFrame, answers: DataFrame, frames: DataFrame, budget: Budget, keyframes: DataFrame | None = None) -> DataFrame:
    """The requests that follow a survey's answers (video_id, ts_ms, score), up to the frame budget of every video, as of `selected`.

    videos: video_id, duration_ms; frames: video_id, ts_ms, score, by which requests are answered; keyframes: video_id, kf_ms.
    """
    return _searched(videos, answers, frames, budget, keyframes)


def selected(videos: DataFrame, frames: DataFrame, budget: Budget, keyframes: DataFrame | None = None, arrival: str | None = None) -> DataFrame:
    """All requests of survey (level 0) and refinement: video_id, place (null in the survey), ts_ms, level, priority, on_keyframe, served_ms, score.

    arrival: a column of frames that were delivered more than once; of those of one time the first counts.
    """
    return _searched(videos, None, frames, budget, keyframes, arrival)


def request_stats(requests: DataFrame) -> DataFrame:
    """video_id, surveyed, refined, failed, frames (distinct ones that answered), duplicates (answers that had been given before)."""
    sound = F.col("score").isNotNull()
    counted = requests.groupBy("video_id").agg(
        F.count_if(F.col("level") == 0).alias("surveyed"),
        F.count_if(F.col("level") > 0).alias("refined"),
        F.count_if(~sound).alias("failed"),
        F.countDistinct(F.when(sound, F.col("served_ms"))).alias("frames"),
    )
    return counted.withColumn("duplicates", F.col("surveyed") + F.col("refined") - F.col("failed") - F.col("frames"))
