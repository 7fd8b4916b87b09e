"""The timeline of a video as state that a late frame touches in a few places only.

Frames lie in time buckets. What verdicts need of a bucket is a Part: counts, its first and last frame, how much its gaps
vouch for, its best scores, and where its flagged frames begin and end. Parts of neighbours join into the part of both, so
parts of FAN buckets make a node, FAN nodes one above, and the top node is the whole video. A batch of frames reads and
writes the buckets that it falls into and the nodes above them, whatever order frames come in and however many there are.

Evidence of its own is only counted up to what a verdict asks for, by going down from the top to the first flagged frame
that is far enough from the one before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple, Protocol

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.constants import TOP_K, VOUCH_RADIUS_MS, Policy
from tidemark.operators.buckets import BUCKET_MS

FAN = 64
FRAMES = "ts array<long>, arrival array<long>, score array<double>"
NODE = "part array<struct<child long, n long, first long, last long, gaps long, best array<double>, flagged_first long, flagged_last long>>"


class Part(NamedTuple):
    n: int
    first: int
    last: int
    gaps: int
    best: list[float]
    flagged_first: int | None
    flagged_last: int | None


class Store(Protocol):
    """Lists by key, as a MapState holds them."""

    def get(self, key: tuple) -> list: ...

    def put(self, key: tuple, value: list) -> None: ...


def vouched(gap: int) -> int:
    """What two neighbours vouch for of the time between them."""
    return min(2 * VOUCH_RADIUS_MS, gap)


def part_of(frames: list[tuple[int, int, float | None]], threshold: float) -> Part:
    """Frames (ts, arrival, score) in order of time."""
    times = [t for t, _, _ in frames]
    scores = sorted((s for _, _, s in frames if s is not None), reverse=True)
    flagged = [t for t, _, s in frames if s is not None and s >= threshold]
    gaps = sum(vouched(b - a) for a, b in zip(times, times[1:], strict=False))
    return Part(len(times), times[0], times[-1], gaps, scores[:TOP_K], flagged[0] if flagged else None, flagged[-1] if flagged else None)


def joined(parts: Iterable[Part]) -> Part:
    """Parts in order of time."""
    whole = None
    for p in parts:
        if whole is None:
            whole = p
            continue
        begins = p.flagged_first if whole.flagged_first is None else whole.flagged_first
        ends = whole.flagged_last if p.flagged_last is None else p.flagged_last
        whole = Part(whole.n + p.n, whole.first, p.last, whole.gaps + p.gaps + vouched(p.first - whole.last), sorted(whole.best + p.best, reverse=True)[:TOP_K], begins, ends)
    return whole


class Timeline:
    """frames: lists (ts, arrival, score) by (bucket,); nodes: lists (child, Part) by (level, number); top: the level of the node over all."""

    def __init__(self, frames: Store, nodes: Store, threshold: float, top: int = 0, width: int = BUCKET_MS, fan: int = FAN):
        self.frames, self.nodes, self.threshold, self.top, self.width, self.fan = frames, nodes, threshold, top, width, fan
        self.whole: Part | None = None

    def _bucket(self, ts: int) -> int:
        return max(0, ts // self.width)

    def add(self, rows: Iterable[tuple[int, int, float | None]]) -> None:
        """Take deliveries; of the deliveries of one time the first to arrive counts, whichever comes first here."""
        fresh: dict[int, list] = {}
        for row in rows:
            fresh.setdefault(self._bucket(row[0]), []).append(tuple(row))
        changed: dict[int, Part] = {}
        for bucket, new in fresh.items():
            held = {t: (t, a, s) for t, a, s in self.frames.get((bucket,))}
            for t, a, s in new:
                if t not in held or a < held[t][1]:
                    held[t] = (t, a, s)
            ordered = sorted(held.values(), key=lambda f: f[0])
            self.frames.put((bucket,), ordered)
            changed[bucket] = part_of(ordered, self.threshold)
        before, level = self.top, 0
        while level == 0 or level < before or max(changed) > 0:
            if 0 < level == before and 0 not in changed:  # what was the whole becomes the first child of the new top
                changed[0] = joined(p for _, p in self.nodes.get((level, 0)))
            above: dict[int, dict[int, Part]] = {}
            for child, part in changed.items():
                above.setdefault(child // self.fan, {})[child] = part
            level, changed = level + 1, {}
            for number, parts in above.items():
                children = sorted((dict(self.nodes.get((level, number))) | parts).items())
                self.nodes.put((level, number), children)
                changed[number] = joined(p for _, p in children)
        self.top, self.whole = level, changed[0]

    def flagged_from(self, ts: int) -> int | None:
        """The first flagged frame at or after a time."""
        level, number = self.top, 0
        while level:
            later = (child for child, p in self.nodes.get((level, number)) if p.flagged_last is not None and p.flagged_last >= ts)
            number = next(later, None)
            if number is None:
                return None
            level -= 1
        return next(t for t, _, s in self.frames.get((number,)) if t >= ts and s is not None and s >= self.threshold)

    def independent(self, gap: int, most: int) -> int:
        """How many flagged frames are evidence of their own, up to `most`."""
        n, at = 0, self.whole.flagged_first
        while at is not None and n < most:
            n += 1
            at = self.flagged_from(at + max(1, gap)) if n < most else None
        return n

    def coverage(self, duration: int) -> float:
        if duration <= 0:
            return 0.0
        end = lambda x: max(0, min(VOUCH_RADIUS_MS, x))
        return max(0.0, min(1.0, (self.whole.gaps + end(self.whole.first) + end(duration - self.whole.last)) / duration))


class _Kept:
    """A MapState as a store of lists: packed into a value, and unpacked from one."""

    def __init__(self, state, pack, unpack):
        self.state, self.pack, self.unpack = state, pack, unpack

    def get(self, key: tuple) -> list:
        held = self.state.getValue(key)  # a round trip to the state store
        return [] if held is None else self.unpack(held)

    def put(self, key: tuple, value: list) -> None:
        self.state.updateValue(key, self.pack(value))


class VerdictProcessor(StatefulProcessor):
    """Rows (ts_ms, arrival, score, duration_ms) of a video -> what its verdict rests on, in one row whenever it changed."""

    #: After the key.
    OUT = "n_frames long, max_score double, topk_mean double, independent long, coverage double, frames_before long, duration_ms long"

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        frames, nodes = handle.getMapState("frames", "bucket long", FRAMES), handle.getMapState("nodes", "level int, number long", NODE)
        self.frames = _Kept(frames, lambda rows: tuple(map(list, zip(*rows, strict=True))), lambda v: list(zip(*v, strict=True)))
        self.nodes = _Kept(nodes, lambda parts: ([(child, *p) for child, p in parts],), lambda v: [(p[0], Part(*p[1:])) for p in v[0]])
        self.video = handle.getValueState("video", "duration long, top int, frames long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        duration, top, before = self.video.get() or (None, 0, 0)
        line, taken = Timeline(self.frames, self.nodes, self.policy.frame_threshold, top), []
        for r in rows:
            taken.append((r["ts_ms"], r["arrival"], r["score"]))
            if r["duration_ms"] is not None and (duration is None or r["duration_ms"] > duration):
                duration = r["duration_ms"]
        line.add(taken)
        self.video.update((duration, line.top, line.whole.n))
        best = line.whole.best
        # more of them change neither a verdict nor its confidence
        some = line.independent(self.policy.gap_ms, max(2, self.policy.min_flagged))
        mean = sum(best) / len(best) if best else None
        yield Row(video_id=key[0], n_frames=line.whole.n, max_score=best[0] if best else 0.0, topk_mean=mean, independent=some, coverage=line.coverage(duration or 0), frames_before=before, duration_ms=duration)

    def close(self) -> None:
        pass


class RunsProcessor(StatefulProcessor):
    """Rows (ts_ms, arrival, score, duration_ms) of a video's bucket -> its runs of flagged frames, in one row whenever the bucket changed."""

    OUT = "runs array<struct<first: long, last: long, d: long, peak_score: double, peak_ts_ms: long>>"

    def __init__(self, threshold: float, merge_gap: int):
        self.threshold, self.merge_gap = threshold, merge_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", FRAMES + ", duration long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        times, arrivals, scores, duration = self.held.get() or ([], [], [], None)
        held = {t: (a, s) for t, a, s in zip(times, arrivals, scores, strict=True)}
        for r in rows:
            t, a = r["ts_ms"], r["arrival"]
            if t not in held or a < held[t][0]:
                held[t] = (a, r["score"])
            duration = max(x for x in (duration, r["duration_ms"], 0) if x is not None)
        ordered = sorted(held.items())
        self.held.update(([t for t, _ in ordered], [a for _, (a, _) in ordered], [s for _, (_, s) in ordered], duration))
        runs: list[list] = []
        for t, (_, s) in ordered:
            if s is None or s < self.threshold:
                continue
            if not runs or t - runs[-1][1] > self.merge_gap:
                runs.append([t, t, duration, s, t])
            else:
                runs[-1][1] = t
                if s > runs[-1][3]:
                    runs[-1][3:] = [s, t]
        yield Row(video_id=key[0], bucket=key[1], runs=[tuple(r) for r in runs])

    def close(self) -> None:
        pass
