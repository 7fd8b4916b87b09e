"""A hidden Markov model over word classes: Baum-Welch counts and the scaled forward recursion, in numpy.

Sequences come concatenated: `classes` holds the class of every token, `starts` where each sequence begins. All
sequences advance together, the longest first, so that a step works on those that are still running.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Least weight of the corpus' class shares in a state's emissions, and of an even spread in its transitions, in tokens.
PRIOR_EMIT, PRIOR_MOVE = 20.0, 1.0
#: Steps, and tokens, whose variables are held at once, at most (one step at least). Of the stretches of steps before, the
#: variables at their borders are kept, and the rest is computed again.
STRETCH, FLUSH = 1 << 16, 500_000
#: Tokens whose transitions are added up in four bytes a number.
ADDED = 8192
#: Rounds of clustering texts for a first model and of Baum-Welch on them, and the chance to stay in a state before any
#: transition is counted.
CLUSTERING, ROUNDS, STAY = 8, 10, 0.9


def smoothed(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Emissions (classes, states) that fall back on the shares as often as new classes turn up (Witten and Bell)."""
    weight = np.maximum(np.minimum(counts, 1).sum(axis=0), PRIOR_EMIT)
    emit = counts + weight * shares[:, None]
    return emit / emit.sum(axis=0)


@dataclass
class Model:
    start: np.ndarray  # (states,): the first token's state
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def zero(cls, states: int, classes: int) -> Counts:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)))

    def model(self, shares: np.ndarray) -> Model:
        states = len(self.start)
        move = self.move + PRIOR_MOVE / states
        start = self.start + PRIOR_MOVE / states
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), smoothed(self.emit, shares))


class _Steps:
    """Tokens in the order of steps: the t-th tokens of all sequences that have one, the longest sequence first."""

    def __init__(self, classes: np.ndarray, starts: np.ndarray):
        lengths = np.diff(np.append(starts, len(classes)))
        self.order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max()) if len(lengths) else 0
        rank = np.empty(len(lengths), dtype=np.int64)
        rank[self.order] = np.arange(len(lengths))
        self.running = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), "right")
        self.at = np.append(0, np.cumsum(self.running))
        within = np.arange(len(classes)) - np.repeat(starts, lengths)
        self.classes = np.empty(len(classes), dtype=np.int32)
        self.classes[self.at[within] + np.repeat(rank, lengths)] = classes

    def stretches(self) -> list[tuple[int, int]]:
        """First steps and ends of stretches of at most STRETCH steps and FLUSH tokens, or of one step."""
        bounds, first = [], 0
        while first < len(self.running):
            end = int(np.searchsorted(self.at, self.at[first] + FLUSH, "right")) - 1
            bounds.append((first, max(first + 1, min(end, first + STRETCH))))
            first = bounds[-1][1]
        return bounds

    def columns(self, first: int, end: int) -> np.ndarray:
        """Of each token of a stretch its place within its step."""
        return np.arange(self.at[first], self.at[end]) - np.repeat(self.at[first:end], self.running[first:end])


def _picked(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Columns of a table (states, any)."""
    out = np.empty((len(table), len(at)), dtype=table.dtype)
    for k, row in enumerate(table):
        np.take(row, at, out=out[k], mode="clip")
    return out


class _Forward:
    """The scaled forward recursion over stretches of steps."""

    def __init__(self, model: Model, steps: _Steps):
        self.steps, self.at = steps, steps.at.tolist()
        self.start = model.start.astype(np.float32)[:, None]
        self.emit, self.move = np.ascontiguousarray(model.emit.T, dtype=np.float32), np.ascontiguousarray(model.move.T, dtype=np.float32)

    def __call__(self, first: int, end: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a stretch's tokens: emissions and forward variables (states, tokens), and what scaled these to a sum of 1.

        before: forward variables of the step before.
        """
        at, base = self.at, self.at[first]
        here = _picked(self.emit, self.steps.classes[base : at[end]].astype(np.intp))
        alphas, scales = np.empty_like(here), np.empty(here.shape[1], dtype=np.float32)
        for t in range(first, end):
            a, b = at[t] - base, at[t + 1] - base
            now, scale = alphas[:, a:b], scales[a:b]
            if before is None:
                np.multiply(here[:, a:b], self.start, out=now)
            else:
                np.matmul(self.move, before[:, : b - a], out=now)
                np.multiply(now, here[:, a:b], out=now)
            np.add.reduce(now, axis=0, out=scale)
            np.divide(now, scale, out=now)
            before = now
        return here, alphas, scales


def log10_likelihood(model: Model, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 P of every sequence by the forward recursion, scaled at each step. No sequence may be empty."""
    steps = _Steps(classes, starts)
    forward, logs, before = _Forward(model, steps), np.zeros(len(starts)), None
    for first, end in steps.stretches():
        _, alphas, scales = forward(first, end, before)
        logs += np.bincount(steps.columns(first, end), np.log10(scales), minlength=len(starts))
        before = alphas[:, -steps.running[end - 1] :].copy()
    out = np.empty(len(starts))
    out[steps.order] = logs
    return out


def _alike(classes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sequences in groups of like lengths, of at most FLUSH tokens or one sequence: most are one stretch."""
    lengths = np.diff(np.append(starts, len(classes)))
    order = np.argsort(-lengths, kind="stable")
    ends = np.append(0, np.cumsum(lengths[order]))
    first = 0
    while first < len(order):
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + FLUSH, "right")) - 1)
        begins = ends[first:end] - ends[first]
        moved = np.repeat(starts[order[first:end]] - begins, lengths[order[first:end]])
        yield classes[moved + np.arange(len(moved))], begins
        first = end


def baum_welch(model: Model, classes: np.ndarray, starts: np.ndarray, into: Counts) -> None:
    """Add the expected counts of whole sequences to `into`."""
    for some, begins in _alike(classes, starts):
        _add_counts(model, _Steps(some, begins), into)


def _add_counts(model: Model, steps: _Steps, into: Counts) -> None:
    """Forward variables are kept at the borders of stretches only; going backwards, those of a stretch are computed again
    (not those of the last), while the backward variables are carried over the borders.

    What scaled a token's forward variables scales its backward variables too, so that their product is the token's state
    weights.
    """
    forward, move, states = _Forward(model, steps), model.move.astype(np.float32), len(model.start)
    stretches, borders = steps.stretches(), [None]
    for first, end in stretches[:-1]:
        alphas = forward(first, end, borders[-1])[1]
        borders.append(alphas[:, -steps.running[end - 1] :].copy())
    at, moves, ahead, later = forward.at, np.zeros((states, states)), None, None
    for first, end in reversed(stretches):
        base, n, before = at[first], int(steps.running[first]), borders.pop()
        here, alphas, scales = forward(first, end, before)
        here /= scales
        weights = np.ones_like(alphas)
        for t in range(end - 1, first - 1, -1):
            a, b = at[t] - base, at[t + 1] - base
            if ahead is not None:  # the sequences that go on
                np.matmul(move, ahead, out=weights[:, a : a + ahead.shape[1]])
            ahead = here[:, a:b]
            np.multiply(ahead, weights[:, a:b], out=ahead)
        if end < len(steps.running):
            moves += alphas[:, at[end - 1] - base :][:, : later.shape[1]] @ later.T
        weights *= alphas
        total = weights.sum(axis=0)  # 1, but for rounding
        weights /= total
        here /= total
        went = np.arange(n, here.shape[1]) - np.repeat(steps.running[first : end - 1], steps.running[first + 1 : end])
        for k in range(0, len(went), ADDED):
            some = went[k : k + ADDED]
            moves += _picked(alphas, some) @ here[:, n + k : n + k + len(some)].T
        where = steps.classes[base : at[end]].astype(np.intp)
        for k in range(states):
            into.emit[:, k] += np.bincount(where, weights[k], minlength=len(into.emit))
        if first == 0:
            into.start += weights[:, :n].sum(axis=1)
        ahead = later = here[:, :n].copy()
    into.move += moves * model.move


def mixture(logs: np.ndarray, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How far each sequence belongs to each of the unigram models whose log probabilities are logs (classes, models)."""
    fits = np.stack([np.add.reduceat(np.ascontiguousarray(logs[:, k])[classes], starts) for k in range(logs.shape[1])], axis=1)
    belongs = np.exp(fits - fits.max(axis=1, keepdims=True))
    return belongs / belongs.sum(axis=1, keepdims=True)


def seeded(classes: np.ndarray, lengths: np.ndarray, shares: np.ndarray, states: int, seed: int) -> Model:
    """A first model from some texts: clusters of them by their classes, begun from texts that the others explain worst, then Baum-Welch."""
    random = np.random.default_rng(seed)
    starts = np.append(0, np.cumsum(lengths)[:-1])
    text = np.repeat(np.arange(len(lengths)), lengths)

    def unigram(weights: np.ndarray) -> np.ndarray:
        return smoothed(np.bincount(classes, weights, minlength=len(shares))[:, None], shares)[:, 0]

    def fit(table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.log(table)[classes], starts)

    tables = [unigram(text == int(random.integers(len(lengths))))]
    fits = [fit(tables[0])]
    while len(tables) < states:  # the text that the others explain worst per token, of long enough ones
        worst = np.max(fits, axis=0) / lengths + (lengths < 20) * 1e9
        tables.append(unigram(text == int(np.argmin(worst))))
        fits.append(fit(tables[-1]))
    for _ in range(CLUSTERING):
        belongs = mixture(np.log(np.array(tables)).T, classes, starts)
        tables = [unigram(belongs[text, k]) for k in range(states)]
    move = np.full((states, states), (1 - STAY) / states) + STAY * np.eye(states)
    model = Model(np.full(states, 1 / states), move, np.array(tables).T)
    for _ in range(ROUNDS):
        counts = Counts.zero(states, len(shares))
        baum_welch(model, classes, starts, counts)
        model = counts.model(shares)
    return model
