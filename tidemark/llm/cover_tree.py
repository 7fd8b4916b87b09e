"""Cover trees over unit vectors, and their dual traversal for all pairs within a radius.

Levels are nested and their radii halve: the centres of a level lie further apart than its radius, every point lies within
the radius of one, and a centre is a centre of all deeper levels, too. A node holds the points that its centre covers,
with the distance of the farthest as its cover. Groups of up to LEAF points aren't divided any more: those of one node
are pooled into a leaf.

The traversal takes a node of each tree. With d between their centres, no pair is within r if d > r + both covers; all are
if d + both covers <= r, which are then counted and linked without being listed; else the larger node is divided. Leaves are
compared by one matrix product in double precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

LEAF = 32
#: Candidates for centres that are taken at once.
STEP = 64
#: Far above what rounding does to a distance; pairs that bounds can't tell apart are compared themselves.
SLACK = 1e-6
#: Cells of a product that are compared at once.
TILE = 1 << 21


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors, none of which is zero, at length one."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def apart(cosine):
    """The distance of unit vectors with this inner product."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def net(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(centres, owner): centres further apart than the radius, the first point first; owner: the nearest of those that a point met first."""
    near = min(1 - radius * radius / 2, 1 - 1e-12)
    owner, left, centres = np.empty(len(points), dtype=np.int64), np.arange(len(points)), []
    while len(left):
        batch = left[: STEP if centres else 1]
        close = points[batch] @ points[batch].T >= near
        free, chosen = np.ones(len(batch), dtype=bool), []
        for k in range(len(batch)):
            if free[k]:
                chosen.append(k)
                free &= ~close[k]
                free[k] = False
        new = batch[chosen]
        cosine = points[left] @ points[new].T
        best = cosine.argmax(axis=1)
        held = cosine[np.arange(len(left)), best] >= near
        owner[left[held]] = len(centres) + best[held]
        centres += new.tolist()
        left = left[~held]
    return np.array(centres, dtype=np.int64), owner


def levels(points: np.ndarray, least: int, radius: float = 2.0) -> np.ndarray:
    """Centres of the first level with `least` of them at least, cut to so many, coarser levels' first; of the deepest, if none has."""
    order = np.arange(len(points))
    while True:
        centres, _ = net(points[order], radius)
        order = np.concatenate([order[centres], np.delete(order, centres)])  # a level's centres come first on the next one
        if len(centres) >= min(least, len(points)) or radius < SLACK:
            return order[: min(len(centres), least)]
        radius /= 2


@dataclass
class Node:
    centre: np.ndarray
    start: int
    end: int
    cover: float
    children: list[Node] = field(default_factory=list)


class Tree:
    """order: the points so that every node is a range of them; weight: how many copies a point stands for."""

    def __init__(self, points: np.ndarray, weight: np.ndarray):
        self.order = np.arange(len(points))
        self.points, self.weight = points, weight
        if len(points):
            self.root = self._node(0, len(points), 2.0)
            self.points, self.weight = points[self.order], weight[self.order]
        self.total = np.append(0, np.cumsum(self.weight))

    def _node(self, start: int, end: int, radius: float) -> Node:
        """The node of a range whose first point is its centre; what is below it is put in order."""
        done, top = [], None
        stack = [(start, end, radius, None)]
        while stack:
            start, end, radius, parent = stack.pop()
            own = self.points[self.order[start:end]]
            node = Node(own[0], start, end, float(apart(own @ own[0]).max()))
            done.append(node)
            top = top or node
            if parent is not None:
                parent.children.append(node)
            if end - start <= LEAF or node.cover < 4 * SLACK:
                continue
            while radius / 2 > node.cover:
                radius /= 2
            centres, owner = net(own, radius / 2)
            while len(centres) == 1:
                radius /= 2
                centres, owner = net(own, radius / 2)
            size = np.bincount(owner)
            small = size[owner] <= LEAF
            # groups side by side, each with its centre first; small ones behind all others
            first = np.ones(len(own), dtype=bool)
            first[centres] = False
            self.order[start:end] = self.order[start:end][np.lexsort((first, owner, small))]
            at = start
            for k in np.flatnonzero(size > LEAF):
                stack.append((at, at + int(size[k]), radius / 2, node))
                at += int(size[k])
            if at < end:
                pool = self.points[self.order[at:end]]
                node.children.append(Node(node.centre, at, end, float(apart(pool @ node.centre).max())))
        return top


class Groups:
    """The smallest number that each of n is joined with."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def grown(self, n: int) -> None:
        self.label = np.append(self.label, np.arange(len(self.label), len(self.label) + n))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


class Links:
    """What a dual traversal of trees a and b finds: links of every point, and groups in which b's points are numbered behind a's.

    If b is a, pairs are of different points of a. visited: cells of products that were compared.
    """

    def __init__(self, a: Tree, b: Tree, cosine: float, groups: Groups, behind: int):
        self.a, self.b, self.cosine, self.groups, self.behind = a, b, cosine, groups, behind
        self.radius = math.sqrt(2 - 2 * cosine)
        self.count_a = np.zeros(len(a.points), dtype=np.int64)
        self.count_b = self.count_a if a is b else np.zeros(len(b.points), dtype=np.int64)
        self.visited = 0
        if len(a.points) and len(b.points):
            self._traverse()

    def _traverse(self) -> None:
        stack = [(self.a.root, self.b.root)]
        while stack:
            x, y = stack.pop()
            d = 0.0 if x is y else float(apart(x.centre @ y.centre))
            if d > self.radius + x.cover + y.cover + SLACK:
                continue
            if d + x.cover + y.cover < self.radius - SLACK:
                self._all(x, y)
            elif not x.children and not y.children:
                self._compare(x, y)
            elif x is y and self.a is self.b:
                stack += [(u, v) for k, u in enumerate(x.children) for v in x.children[k:]]
            elif x.children and (not y.children or x.end - x.start >= y.end - y.start):
                stack += [(u, y) for u in x.children]
            else:
                stack += [(x, v) for v in y.children]

    def _all(self, x: Node, y: Node) -> None:
        """Every pair is a link."""
        a, b = np.arange(x.start, x.end), np.arange(y.start, y.end) + self.behind
        self.count_a[x.start : x.end] += self.b.total[y.end] - self.b.total[y.start]
        if x is y and self.a is self.b:
            self.count_a[x.start : x.end] -= self.a.weight[x.start : x.end]
        else:
            self.count_b[y.start : y.end] += self.a.total[x.end] - self.a.total[x.start]
        self.groups.join(a, np.full(len(a), b[0]))
        self.groups.join(b, np.full(len(b), a[0]))

    def _compare(self, x: Node, y: Node) -> None:
        step = max(1, TILE // (y.end - y.start))
        for at in range(x.start, x.end, step):
            stop = min(x.end, at + step)
            hit = self.a.points[at:stop] @ self.b.points[y.start : y.end].T >= self.cosine
            self.visited += hit.size
            if x is y and self.a is self.b:  # each pair is seen from both sides here
                hit[np.arange(stop - at), np.arange(at, stop) - y.start] = False
                self.count_a[at:stop] += hit @ self.b.weight[y.start : y.end]
            elif hit.any():
                self.count_a[at:stop] += hit @ self.b.weight[y.start : y.end]
                self.count_b[y.start : y.end] += self.a.weight[at:stop] @ hit
            while hit.any():  # the first link of every row and column joins nearly all; what still differs is taken again
                i, j = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
                rows = np.append(i, hit[:, j].argmax(axis=0)) + at
                columns = np.append(hit[i].argmax(axis=1), j) + y.start + self.behind
                self.groups.join(rows, columns)
                label = self.groups.label
                hit &= label[at:stop, None] != label[None, y.start + self.behind : y.end + self.behind]
