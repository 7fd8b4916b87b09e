"""Groups of near hashes against all pairs."""

import random

import numpy as np
import pytest

from tidemark.operators import near_groups


def brute(values, radius):
    distinct = sorted({h for h in values if h})
    x = np.array(distinct, dtype=np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius if len(x) else np.zeros((0, 0), dtype=bool)
    np.fill_diagonal(near, False)
    out, group = set(), list(range(len(x)))
    for _ in range(len(x)):
        new = [min([group[k], *(group[j] for j in np.flatnonzero(near[k]))]) for k in range(len(x))]
        if new == group:
            break
        group = new
    for k, h in enumerate(distinct):
        out.add((f"{h:016x}", values.count(h), int(near[k].sum()), f"{distinct[group[k]]:016x}"))
    return out


def flipped(r, h, most):
    for bit in r.sample(range(64), r.randrange(most + 1)):
        h ^= 1 << bit
    return h


@pytest.mark.parametrize(("radius", "block"), [(6, 16_384), (6, 5), (3, 7), (0, 4), (10, 30)])
def test_groups_equal_all_pairs(spark, radius, block):
    r = random.Random(radius + block)
    base = [r.getrandbits(64) for _ in range(25)]
    values = [flipped(r, r.choice(base[:20] if k % 3 else base[:1]), radius) for k in range(260)] + base + [0] * 5 + [base[0]] * 40
    table = spark.createDataFrame([(f"{h:016x}",) for h in values], "hash string").repartition(3)
    assert {tuple(x) for x in near_groups.near_groups(table, radius, block).collect()} == brute(values, radius)


def test_no_hashes_no_groups(spark):
    assert near_groups.near_groups(spark.createDataFrame([("0" * 16,), (None,)], "hash string")).count() == 0


def test_a_hot_group_gives_rows_not_pairs(spark):
    """A thousand distinct hashes, all near each other: half a million pairs are counted, and none is listed."""
    r, base = random.Random(1), random.Random(2).getrandbits(64)
    values = {flipped(r, base, 3) for _ in range(1000)}
    table = spark.createDataFrame([(f"{h:016x}",) for h in values], "hash string")
    found = near_groups.near_groups(table, 6, block=100).collect()
    assert {x.n_near for x in found} == {len(values) - 1} and len({x.group_hash for x in found}) == 1


def test_parts_cover_all_bits_and_pigeons():
    for radius in (0, 3, 6, 10):
        cuts = near_groups.parts(radius)
        assert len(cuts) == max(radius + 1, 5) and max(w for _, w in cuts) <= 13 and sum(w for _, w in cuts) == 64
        assert sum(((1 << w) - 1) << s for s, w in cuts) == 2**64 - 1
