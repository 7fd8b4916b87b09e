import numpy as np
import pytest

from tidemark.llm import cover_dedup, cover_tree

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, cell int, copies int"


def made(spark, rows, **sizes):
    table = spark.createDataFrame([(i, v, 0, "own", 1, 2) for i, v in rows], SCHEMA).repartition(5)
    found = cover_dedup.near_vectors(table, **sizes).collect()
    assert len(found) == len(rows)
    return sorted((tuple(r) for r in found), key=str)


def brute(rows, cosine=0.95):
    sound = [k for k, (_, v) in enumerate(rows) if v is not None and any(v) and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(rows[k][1]) for k in sound), default=0)
    points = np.array([np.append(np.float32(rows[k][1]).astype(float), np.zeros(width - len(rows[k][1]))) for k in sound])
    near = np.zeros((len(rows), len(rows)), dtype=bool)
    if sound:
        near[np.ix_(sound, sound)] = cover_tree.unit(points) @ cover_tree.unit(points).T >= cosine
    np.fill_diagonal(near, False)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = set(np.flatnonzero(near[todo.pop()])) - seen
            seen |= new
            todo += new
        least = min((rows[j][0] for j in seen), key=lambda x: (x is None, x or 0))
        out.append((i, int(near[k].sum()), least, i == least and (i is not None or len(seen) == 1)))
    return sorted(out, key=str)


def clusters(r, count, members, width=16, spread=0.05):
    centres = cover_tree.unit(r.normal(size=(count, width)))
    at = r.integers(0, count, size=members)
    return (centres[at] + spread * r.normal(size=(members, width))).astype(np.float32)


AWKWARD = [None, [], [0.0, 0.0], [1.0, float("nan")], [1.0, None, 0.0], [float("inf")], [1.0], [2.0, 0.0], [1e-30], [1.0, 0.0, 0.2], [-1.0], [1e38, 1e38]]


@pytest.mark.parametrize("block,spread", [(4096, 0.05), (40, 0.05), (25, 0.08), (60, 0.3)])
def test_links_and_components_equal_all_pairs(spark, block, spread):
    r = np.random.default_rng(block)
    vectors = clusters(r, 12, 300, spread=spread)
    rows = [(int(k), v.tolist()) for k, v in zip(r.permutation(10_000)[:300], vectors, strict=True)]
    rows += [(20_000 + k, rows[0][1]) for k in range(90)] + rows[5:8]
    assert made(spark, rows, block=block) == brute(rows)


def test_awkward_vectors(spark):
    rows = [(k, v) for k, v in enumerate(AWKWARD)] + [(None, None), (None, [1.0]), (3, [1.0, 0.01]), (None, [0.0, 0.0, 0.0, 5.0])]
    assert made(spark, rows) == brute(rows)
    assert made(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert made(spark, []) == []


def test_a_hot_group_of_near_copies_over_many_blocks(spark):
    r = np.random.default_rng(3)
    near = np.eye(1, 16)[0] + 0.03 * r.normal(size=(400, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([near, r.normal(size=(300, 16))]).astype(np.float32))]
    assert made(spark, rows, block=64) == brute(rows)


@pytest.mark.parametrize("kind", ["plain", "clusters", "tight", "line"])
def test_dual_traversal_equals_all_pairs(kind):
    r = np.random.default_rng(5)
    made = {
        "plain": lambda: r.normal(size=(500, 16)),
        "clusters": lambda: clusters(r, 6, 500).astype(float),
        "tight": lambda: clusters(r, 3, 500, spread=1e-5).astype(float),
        "line": lambda: np.stack([np.cos(t := np.linspace(0, 3, 500)), np.sin(t)], axis=1),
    }[kind]()
    points, weight = cover_tree.unit(made), r.integers(1, 4, size=500)
    a, b = cover_tree.Tree(points[:300], weight[:300]), cover_tree.Tree(points[300:], weight[300:])
    groups = cover_tree.Groups(500)
    inside = cover_tree.Links(a, a, 0.95, groups, 0)
    across = cover_tree.Links(a, b, 0.95, groups, 300)
    near = points @ points.T >= 0.95
    np.fill_diagonal(near, False)
    order = np.concatenate([a.order, 300 + b.order])
    w = np.concatenate([a.weight, b.weight])
    near = near[np.ix_(order, order)]
    assert (inside.count_a == near[:300, :300] @ w[:300]).all()
    assert (across.count_a == near[:300, 300:] @ w[300:]).all()
    assert (across.count_b == near[300:, :300] @ w[:300]).all()
    reach = near | np.eye(500, dtype=bool)
    reach[300:, 300:] = np.eye(200, dtype=bool)  # pairs of b aren't looked for
    for _ in range(9):
        reach = reach @ reach
    assert ((groups.label[:, None] == groups.label[None, :]) == reach).all()


def test_bounds_spare_comparisons_on_clusters():
    r = np.random.default_rng(6)
    points = cover_tree.unit(clusters(r, 40, 4000, spread=0.03))
    tree = cover_tree.Tree(points, np.ones(4000, dtype=np.int64))
    links = cover_tree.Links(tree, tree, 0.95, cover_tree.Groups(4000), 0)
    assert links.visited < 0.1 * 4000 * 4000


def test_levels_are_nested_and_centres_apart():
    r = np.random.default_rng(7)
    points = cover_tree.unit(clusters(r, 20, 600, spread=0.1))
    for least in (1, 5, 20, 100):
        held = cover_tree.levels(points, least)
        assert len(held) == least == len(set(held.tolist()))
        assert held.tolist()[:1] == [0]
    centres, owner = cover_tree.net(points, 0.5)
    between = cover_tree.apart(points[centres] @ points[centres].T) + 9 * np.eye(len(centres))
    assert between.min() > 0.5
    assert (cover_tree.apart((points * points[centres][owner]).sum(axis=1)) <= 0.5 + 1e-9).all()


def test_of_two_cells_one_visits_the_other():
    a, b = np.indices((50, 50))
    v = cover_dedup.visits(a, b)
    assert (v ^ v.T == (a != b)).all()
    assert (abs(v.sum(axis=1) - 24.5) < 2).all()


def test_clustered_vectors_visit_few_cells(spark):
    r = np.random.default_rng(8)
    centres = cover_tree.unit(r.normal(size=(16, 32)))
    points = cover_tree.unit(np.repeat(centres, 50, axis=0) + 0.02 * r.normal(size=(800, 32)))
    rows = [(k, 1, p.tobytes(), int(k // 50), 0.0) for k, p in enumerate(points)]
    table = spark.createDataFrame(rows, "uid long, copies long, point binary, cell int, away double")
    cover = np.array([cover_tree.apart(points[50 * k : 50 * k + 50] @ centres[k]).max() for k in range(16)])
    dealt = cover_dedup.dealt(table, centres, cover, np.ones(16, dtype=np.int64), np.sqrt(0.1))
    assert dealt.where("kind = 0").count() == 800
    assert dealt.where("kind = 1").count() < 800  # 6,000 if all cells were in reach
