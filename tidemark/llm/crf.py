"""A linear-chain conditional random field over lines with two labels (0 bad, 1 good), in numpy.

A line's score for "good" is linear in its own features and in those of its neighbours; transitions have a weight per
pair of labels. All documents advance together, step by step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: Lines of a document that are taken step by step; longer documents are cut into stretches that advance side by side.
STRETCH = 4096


def with_neighbours(parts: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's sum of its own part (column 0), of what the line before it (1) and the line after it (2) have for it."""
    starts = np.append(0, np.cumsum(lines))[:-1]
    before, after = np.zeros(len(parts)), np.zeros(len(parts))
    before[1:], after[:-1] = parts[:-1, 1], parts[1:, 2]
    before[starts[lines > 0]] = 0
    after[(starts + lines - 1)[lines > 0]] = 0
    return parts[:, 0] + before + after


def to_neighbours(values: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The reverse: (lines, 3), a line's value, the next line's and the previous one's (zeros at a document's ends)."""
    out = np.zeros((len(values), 3), dtype=np.float32)
    starts = np.append(0, np.cumsum(lines))[:-1]
    out[:, 0], out[:-1, 1], out[1:, 2] = values, values[1:], values[:-1]
    out[(starts + lines - 1)[lines > 0], 1] = 0
    out[starts[lines > 0], 2] = 0
    return out


class _Order:
    """Lines in the order of steps: the t-th lines of all documents that have one, the longest document first."""

    def __init__(self, lines: np.ndarray):
        order = np.argsort(-lines, kind="stable")
        rank = np.empty(len(lines), dtype=np.int64)
        rank[order] = np.arange(len(lines))
        longest = int(lines.max()) if len(lines) else 0
        self.running = len(lines) - np.searchsorted(np.sort(lines), np.arange(longest), "right")
        self.at = np.append(0, np.cumsum(self.running))
        starts = np.append(0, np.cumsum(lines))[:-1]
        within = np.arange(int(lines.sum())) - np.repeat(starts, lines)
        self.place = self.at[within] + np.repeat(rank, lines)


def marginals(good: np.ndarray, moves: np.ndarray, lines: np.ndarray, longest: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of every line by forward-backward, and the expected number of each transition.

    good: a line's score for label 1 over label 0; moves: (2, 2) transition scores; lines: per document, none empty. A document of more
    than `longest` lines is cut into stretches: how each carries what comes before and after it is taken first, for all at once.
    """
    many = -(-lines // longest)
    pieces = np.full(int(many.sum()), longest)
    ends = np.cumsum(many) - 1
    pieces[ends] = lines - (many - 1) * longest
    order = _Order(pieces)
    potential = np.empty((2, len(good)))
    ordered = np.empty(len(good))
    ordered[order.place] = np.clip(good, -30, 30)
    potential[1] = 1 / (1 + np.exp(-ordered))
    potential[0] = 1 - potential[1]
    step = np.exp(moves - moves.max())
    enter, leave = np.ones((2, len(pieces))), np.ones((2, len(pieces)))
    at = np.empty(len(pieces), dtype=np.int64)
    at[np.argsort(-pieces, kind="stable")] = np.arange(len(pieces))  # where a piece is among all, the longest first
    begins = np.zeros(len(pieces), dtype=bool)
    begins[ends - many + 1] = True
    if len(ends) < len(pieces):
        _carry(potential, step, order, at, begins, enter, leave)
    alphas, last = [], np.empty((2, len(pieces)))
    for t, n in enumerate(order.running):
        here = potential[:, order.at[t] : order.at[t] + n]
        alpha = here * (step.T @ alphas[-1][:, :n] if t else enter) + (0 if t else 1e-300)
        alphas.append(alpha / alpha.sum(axis=0))
        last[:, :n] = alphas[-1]
    found, expected = np.empty(len(good)), np.zeros((2, 2))
    beta = np.ones((2, 0))
    for t in range(len(alphas) - 1, -1, -1):
        now, n, m = alphas[t], order.running[t], beta.shape[1]
        wider = leave[:, :n] / (now * leave[:, :n]).sum(axis=0)
        if m:
            later = potential[:, order.at[t + 1] : order.at[t + 1] + m] * beta
            back = step @ later
            weight = (now[:, :m] * back).sum(axis=0)
            expected += step * ((now[:, :m] / weight) @ later.T)
            wider[:, :m] = back / weight
        beta = wider
        found[order.at[t] : order.at[t] + n] = now[1] * beta[1]
    for k in np.flatnonzero(~begins):  # from a stretch to the next
        pair = step * np.outer(last[:, at[k - 1]], potential[:, at[k]] * beta[:, at[k]])
        expected += pair / pair.sum()
    return np.clip(found[order.place], 0.0, 1.0), expected


def _carry(potential: np.ndarray, step: np.ndarray, order: _Order, at: np.ndarray, begins: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> None:
    """Fill in what stretches are entered with (2, pieces) and what they leave to, from their products of transitions."""
    count = len(at)
    through, back = np.empty((2, 2, count)), np.empty((2, 2, count))  # [out, in, piece]
    first = np.tile(step.T[:, :, None], (1, 1, count))
    first[:, :, at[begins]] = 1  # a document's first line has no line before it
    for t, n in enumerate(order.running):
        here = potential[:, None, order.at[t] : order.at[t] + n]
        own = here * (np.einsum("ji,jkn->ikn", step, through[:, :, :n]) if t else first)
        through[:, :, :n] = own / own.sum(axis=(0, 1))
    fresh = np.tile(np.eye(2)[:, :, None], (1, 1, count))
    for t in range(len(order.running) - 1, -1, -1):
        n, m = order.running[t], order.running[t + 1] if t + 1 < len(order.running) else 0
        back[:, :, m:n] = fresh[:, :, m:n]
        if m:
            own = np.einsum("ij,jkn->ikn", step, potential[:, None, order.at[t + 1] : order.at[t + 1] + m] * back[:, :, :m])
            back[:, :, :m] = own / own.sum(axis=(0, 1))
    for k in range(count):
        if begins[k]:
            out = np.full(2, 0.5)
        else:
            enter[:, at[k]] = step.T @ out
        out = through[:, :, at[k]] @ out
        out /= out.sum()
    for k in range(count - 1, -1, -1):
        if k + 1 < count and not begins[k + 1]:
            later = potential[:, at[k + 1]] * (back[:, :, at[k + 1]] @ leave[:, at[k + 1]])
            leave[:, at[k]] = step @ (later / later.sum())


@dataclass
class Field:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    scale: float = 1.0  # of a document's log odds
    shift: float = 0.0

    def parts(self, features: np.ndarray) -> np.ndarray:
        """(lines, 3): what lines' features say of the lines themselves, of the next and of the previous ones."""
        plain = ((features - self.mean) / self.spread).astype(np.float32)
        return (plain @ self.weights[:-1].reshape(3, -1).T.astype(np.float32)).astype(np.float64)

    def raw(self, parts: np.ndarray, sizes: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Log odds of each document's length-weighted mean marginal."""
        good, _ = marginals(with_neighbours(parts, lines) + self.weights[-1], self.moves, lines)
        doc = np.repeat(np.arange(len(lines)), lines)
        weight = sizes + 1.0
        mean = np.bincount(doc, good * weight, minlength=len(lines)) / np.bincount(doc, weight, minlength=len(lines))
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def scored(self, parts: np.ndarray, sizes: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.raw(parts, sizes, lines) + self.shift)))

    def score(self, features: np.ndarray, sizes: np.ndarray, lines: np.ndarray) -> np.ndarray:
        return self.scored(self.parts(features), sizes, lines)


def fit(features: np.ndarray, sizes: np.ndarray, lines: np.ndarray, labels: np.ndarray, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Field:
    """Maximum likelihood by Adam, each line carrying its document's label; then the document odds are calibrated.

    A document's lines weigh together as much as another's, so that long documents don't decide alone. features: of four bytes a number
    will do; they are overwritten.
    """
    mean, spread = features.mean(axis=0, dtype=np.float64), features.std(axis=0, dtype=np.float64) + 1e-3
    x = features  # becomes plain numbers in place: the features aren't needed any more
    x -= mean.astype(x.dtype)
    x /= spread.astype(x.dtype)
    width = 3 * x.shape[1] + 1
    line_label = np.repeat(labels, lines).astype(float)
    weight = np.repeat(1.0 / lines, lines)
    field = Field(mean, spread, np.zeros(width), np.zeros((2, 2)))
    first, second = [np.zeros(width + 4) for _ in range(2)]
    starts = np.append(0, np.cumsum(lines))[:-1]
    follows = np.ones(len(x), dtype=bool)
    follows[starts] = False
    own = np.array([[np.sum(follows & (line_label == b)) if a == b else 0 for b in (0, 1)] for a in (0, 1)], dtype=float)
    told = lambda: (x @ field.weights[:-1].reshape(3, -1).T.astype(x.dtype)).astype(np.float64)
    for k in range(1, rounds + 1):
        good, expected = marginals(with_neighbours(told(), lines) + field.weights[-1], field.moves, lines)
        off = (line_label - good) * weight / len(lines)
        slope = np.append((x.T @ to_neighbours(off, lines)).T.ravel(), off.sum()) - decay * field.weights
        turn = (own - expected) / max(follows.sum(), 1) - decay * field.moves
        gradient = np.append(slope, turn.ravel())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        step = rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        field.weights += step[:-4]
        field.moves += step[-4:].reshape(2, 2)
        field.moves = np.clip(field.moves, -2.0, 2.0)  # labels are those of documents: lines must still speak for themselves
    odds = field.raw(told(), sizes, lines)
    a, b = 1.0, 0.0
    for _ in range(100):  # logistic regression on one number, by Newton's steps
        p = 1 / (1 + np.exp(-(a * odds + b)))
        g = np.array([((labels - p) * odds).sum() - 0.01 * (a - 1), (labels - p).sum() - 0.01 * b])
        w = p * (1 - p)
        h = np.array([[(w * odds**2).sum() + 0.01, (w * odds).sum()], [(w * odds).sum(), w.sum() + 0.01]])
        change = np.linalg.solve(h, g)
        a, b = a + float(np.clip(change[0], -0.5, 0.5)), b + float(np.clip(change[1], -0.5, 0.5))
    field.scale, field.shift = a, b
    return field
