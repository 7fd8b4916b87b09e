import numpy as np
import pytest
from tidemark.llm import maxscore


def brute(rows, k, width, asked=lambda i: i % 20 == 0):
    """rows: (id, vector). Every row but the query's own is a candidate."""
    ints = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v] + [0] * (width - len(v))) for i, v in rows]
    out = []
    for at, (q, v) in enumerate(ints):
        if asked(q):
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for n, (c, w) in enumerate(ints) if n != at)[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", ["spread", "sparse", "ties", "hot", "large"])
def test_matches_brute_force(spark, scale):
    rng = np.random.default_rng(4)
    rows = rng.normal(0, 0.2, (400, 12))
    if scale == "sparse":
        rows[rng.random(rows.shape) < 0.8] = 0
    if scale == "ties":
        rows = np.round(rows)
        rows[100:300] = rows[0]
    if scale == "hot":
        rows[:200] = rows[0] + rng.normal(0, 0.01, (200, 12)) * (np.arange(200) % 3 == 0)[:, None]
    if scale == "large":
        rows = rows * 1e6
    rows = list(enumerate(rows.astype(np.float32).tolist()))
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = maxscore.top_k(df, df.where("vec_id % 20 = 0"), k=7, shard=90, least=30, block=8).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 7, 12)


def test_rows_that_repeat_an_id_are_candidates_and_queries_of_their_own(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 30, v) for i, v in enumerate(rng.normal(0, 0.3, (90, 5)).astype(np.float32).tolist())]
    rows += [rows[0], rows[0], rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = maxscore.top_k(df, df.where("vec_id % 20 = 0"), k=6, shard=20, least=20, block=4).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 6, 5)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (20, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in maxscore.top_k(df, df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1, 4096), (0, 2, 6, 0), (0, 3, 20, -12288), (20, 1, 6, 0), (20, 2, 1, -4096), (20, 3, 0, -12288)]
    assert maxscore.top_k(df.where("false"), df.where("false")).count() == 0


def make_shard(impacts, k):
    return maxscore.Shard(impacts, [np.array([i]) for i in range(len(impacts))], k, block=64)


@pytest.mark.parametrize(("data", "most"), [("round", 0.8), ("clusters", 0.1), ("decaying", 0.2)])
def test_postings_are_skipped_and_nothing_is_lost(data, most):
    rng = np.random.default_rng(0)
    vectors = rng.normal(0, 8, (8000, 64))
    if data == "clusters":
        centres = rng.normal(0, 8, (16, 64))
        vectors = centres[np.arange(8000) % 16] + rng.normal(0, 1, (8000, 64))
    if data == "decaying":
        vectors *= 0.9 ** np.arange(64) * 3
    impacts = np.floor(vectors).astype(np.int16)
    queries = impacts[:200]
    scores = queries.astype(np.int64) @ impacts.T.astype(np.int64)
    floor = np.sort(scores[:, :2000], axis=1)[:, -20].astype(float)  # what a first pass over a quarter gives
    shard = make_shard(impacts, 20)
    q, ids, got, same = shard.search(queries, floor)
    for k in range(200):
        want = sorted((-s, i) for i, s in enumerate(scores[k].tolist()))[:20]
        assert [(-s, i) for s, i in zip(got[q == k].tolist(), ids[q == k].tolist(), strict=True)] == want
    assert shard.total == 200 * 8000 * 64
    assert shard.visited < most * shard.total
    assert (ids[same] == q[same]).all()
