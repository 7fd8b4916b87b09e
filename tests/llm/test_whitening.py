import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, index string, x int, copies int"


def made(spark, rows, **sizes):
    table = spark.createDataFrame([(i, v, 0, "own", 1, 2) for i, v in rows], SCHEMA).repartition(4)
    return whitening.whiten(table, **sizes).collect()


def key(i):
    return -1 if i is None else i


def expected(rows, components):
    """x, n, deviation, explained and whitened (up to its sign) per sound row."""
    sound = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(v) for _, v in sound)
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in sound]
    fit = [list(t) for t in {tuple(r) for r in x}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    means = np.array([s / n for s in sums])
    centred = np.array(fit, dtype=float) - means
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = (np.array(x, dtype=float) - means) @ vectors[:, :components] / np.sqrt(values[:components])
    return [i for i, _ in sound], n, deviation, values / values.sum(), white


@pytest.mark.parametrize("block,together", [(1024, 8), (16, 1), (50, 3)])
def test_rows_equal_direct_whitening(spark, monkeypatch, block, together):
    monkeypatch.setattr(whitening, "TOGETHER", together)
    r = np.random.default_rng(block)
    vectors = (r.normal(size=(300, 12)) * np.linspace(3, 0.5, 12)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(k, vectors[0].tolist()) for k in range(300, 400)]
    rows += [(500, None), (501, [1.0, float("nan")]), (502, [None]), (None, vectors[1].tolist()), (7, [0.5] * 3), (503, [])]
    found = made(spark, rows, components=5, block=block)
    ids, n, deviation, share, white = expected(rows, 5)
    assert len(found) == 5 * len(ids)
    assert {r.n for r in found} == {n}
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9
    assert sorted((key(r.vec_id), r.deviation) for r in found if r.component == 1) == sorted((key(i), d) for i, d in zip(ids, deviation, strict=True))
    for c in range(5):
        own = sorted(((key(r.vec_id), r.deviation, r.whitened, r.explained) for r in found if r.component == c + 1))
        want = sorted((key(i), d, w) for i, d, w in zip(ids, deviation, white[:, c], strict=True))
        a, b = np.array([r[2] for r in own]), np.array([r[2] for r in want])
        sign = np.sign(a @ b)
        assert abs(abs(a @ b) / (a @ a) - 1) < 1e-9
        assert np.allclose(sorted(zip([r[0] for r in own], [r[1] for r in own], sign * a, strict=True)), sorted(zip([r[0] for r in want], [r[1] for r in want], b, strict=True)), atol=1e-8)
        assert abs(own[0][3] - share[c]) < 1e-12


def test_tables_without_rows_or_variance(spark):
    assert made(spark, []) == []
    assert made(spark, [(1, None), (2, [])]) == []
    assert made(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []


def test_components_without_variance_are_left_out(spark):
    rows = [(k, [float(k % 7), 1.0, float(k % 5)]) for k in range(60)]
    assert {r.component for r in made(spark, rows)} == {1, 2}


def test_huge_components_stay_exact_or_null(spark):
    found = made(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1e6, 2.0])], components=1)
    assert {(r.vec_id, r.deviation is None) for r in found} == {(1, True), (2, True), (3, False)}
    rows = [(k, [float(10**7 * (k % 3)), float(k)]) for k in range(9)]
    found = made(spark, rows, components=1)
    ids, _, deviation, _, _ = expected(rows, 1)
    assert {(r.vec_id, r.deviation) for r in found} == {(i, d if d < 2**63 else None) for i, d in zip(ids, deviation, strict=True)}


def test_a_product_with_one_block_is_split(spark):
    """The rows of a transposed product don't meet in one task."""
    table = spark.range(640).selectExpr("id AS index", "array(double(id), 1.0D) AS values")
    blocks = whitening.matrix(table, 640, 2, 10)
    made = whitening.product(blocks.transpose(), blocks, 16)
    assert made.blocks.count() == 1
    assert np.allclose(made.toLocalMatrix().toArray(), [[sum(k * k for k in range(640)), sum(range(640))], [sum(range(640)), 640]])
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("split", "split")
    made.toLocalMatrix()
    stages = [status.getStageInfo(s) for job in status.getJobIdsForGroup("split") for s in status.getJobInfo(job).stageIds]
    assert 16 in {s.numTasks for s in stages if s}
