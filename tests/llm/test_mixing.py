import hashlib
import math
import tracemalloc
from collections import Counter
from decimal import Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import mixing
from tests.llm.helpers import AWKWARD, documents


def test_shares_follow_the_targets(spark):
    docs = documents(spark, [f"text number {k:05d}" for k in range(4000)], source="big").unionByName(documents(spark, [f"text number {k:05d}" for k in range(400)], range(5000, 5400), "small"))
    made = mixing.mix(docs, {"big": 0.5, "small": 0.5})
    n = {r.source: r["count"] for r in made.groupBy("source").count().collect()}
    assert n["small"] / (n["small"] + n["big"]) == pytest.approx(0.5, abs=0.05)
    assert n["small"] + n["big"] == pytest.approx(4400, rel=0.05)
    small = {r.copies: r["count"] for r in made.where("source = 'small' AND copy = 1").groupBy("copies").count().collect()}
    mean = 5.5
    assert small[5] / 400 == pytest.approx(math.exp(-mean) * mean**5 / math.factorial(5), abs=0.06)
    assert [r.mix_key for r in made.collect()] == [r.mix_key for r in mixing.mix(docs, {"big": 0.5, "small": 0.5}).collect()]


def test_order_is_shuffled(spark):
    ids = [r.doc_id for r in mixing.mix(documents(spark, [f"t{k}" for k in range(500)])).collect()]
    assert ids != sorted(ids)


def test_both_paths_agree(spark, monkeypatch):
    docs = documents(spark, AWKWARD + ["again"] * 3, source="s1").unionByName(documents(spark, AWKWARD, range(100, 100 + len(AWKWARD)), None))
    for targets in (None, {"s1": 3.0, "": 1.0}, {"s1": 0.0}):
        few = sorted((r.doc_id, r.copy, r.copies) for r in mixing.mix(docs, targets).collect())
        monkeypatch.setattr(mixing, "MAX_BROADCAST", 1)
        many = sorted((r.doc_id, r.copy, r.copies) for r in mixing.mix(docs, targets).collect())
        monkeypatch.undo()
        assert few == many and (targets != {"s1": 0.0} or all(i >= 100 for i, _, _ in few))


def test_edges(spark):
    docs = documents(spark, AWKWARD)
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(docs, marks=False).columns == docs.columns
    clashing = docs.withColumn("copy", F.lit(-1)).withColumn("__mix_doc", F.lit(-2)).withColumn("s", F.lit(-3))
    made = mixing.mix(clashing)
    assert made.columns == [*clashing.columns, "copy_", "copies", "mix_key"] and made.select("copy", "__mix_doc", "s").distinct().collect() == [(-1, -2, -3)]


def smallest(mean, u):
    """The smallest k whose exact cumulative probability exceeds u, by high-precision sums."""
    with localcontext() as c:
        c.prec = 60
        p, k = (-Decimal(mean)).exp(), 0
        total = p
        while total <= Decimal(u):
            k += 1
            p = p * Decimal(mean) / k
            total += p
    return k


@pytest.mark.parametrize("mean", [0.001, 0.7, 1.0, 30.0, 999.5])
def test_inverse_is_the_smallest_count(mean):
    at = np.array([0.0 if mean < 100 else 1e-12, 2.0**-48, 1e-9, 0.1, 0.5, 0.77, 1 - 1e-9, 1 - 1e-11])
    assert mixing.inverse(np.full(len(at), mean), at).tolist() == [smallest(mean, u) for u in at]


def test_large_means_cost_no_memory_and_agree_with_sums():
    at = np.random.default_rng(1).random(3000)
    for mean in (2000.25, 10_000.0):
        low, below = mixing._table(mean)
        assert np.abs(mixing._below(low + np.arange(len(below)), mean) - below).max() < 2e-10
        assert (mixing._large(mean, at) == low + np.searchsorted(below, at, "right")).all()
    for mean in (1e6, 1e9, 3e12):
        tracemalloc.start()
        drawn = mixing.inverse(np.full(len(at), mean), at)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 2_000_000
        assert (mixing._below(drawn.astype(float), mean) > at).all() and (mixing._below(drawn - 1.0, mean) <= at).all()
        assert drawn.mean() == pytest.approx(mean, abs=5 * math.sqrt(mean / 3000)) and drawn.std() == pytest.approx(math.sqrt(mean), rel=0.05)


def test_a_tiny_source_is_repeated_in_blocks(spark, monkeypatch):
    docs = documents(spark, ["x" * 4000] * 5, source="big").unionByName(documents(spark, ["ab"], [77], "tiny"))
    made = mixing.mix(docs)
    rows = made.where("source = 'tiny'").select("copy", "copies", "mix_key").collect()
    n = rows[0].copies
    assert n == pytest.approx(5000, rel=0.1) and sorted(r.copy for r in rows) == list(range(1, n + 1))
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 1)
    assert sorted(mixing.mix(docs).where("source = 'tiny'").select("copy", "copies", "mix_key").collect()) == sorted(rows)


def test_draws_and_copies_by_brute_force(spark):
    """Every document exactly as often as its own draw says."""
    docs = documents(spark, AWKWARD + [f"some text {k}" for k in range(40)], source="s1").unionByName(documents(spark, AWKWARD, range(100, 100 + len(AWKWARD)), None))
    rows = docs.collect()
    size = {}
    for r in rows:
        size[r.source or ""] = size.get(r.source or "", 0) + max(1, len(r.text or ""))
    want = Counter()
    for r in rows:
        mean = sum(size.values()) / 2 / size[r.source or ""]
        key = f"42\x1f{r.doc_id}\x1f{hashlib.md5((r.text or '').encode()).hexdigest()}"
        want[r.doc_id] = smallest(mean, int(hashlib.md5(key.encode()).hexdigest()[:12], 16) / 2**48)
    got = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert +want == got
