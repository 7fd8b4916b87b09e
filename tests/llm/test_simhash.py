import random

import numpy as np
import pytest
import xxhash
from tidemark.llm import bktree, components, simhash_bk
from tests.llm.helpers import AWKWARD, documents, words


def brute_fp(text):
    w = words(text)
    shingles = ([b" ".join(w)] if len(w) < 3 else [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)]) if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


def near_texts(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    out = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(1, 5)):
            own = list(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own))
    return out


def test_groups_match_brute_force(spark):
    texts = AWKWARD + near_texts()
    got = {r.doc_id: (int.from_bytes(r.fp, "little"), r.component_id) for r in simhash_bk.near_groups(documents(spark, texts)).collect()}
    fps = {i: brute_fp(t) for i, t in enumerate(texts)}
    assert {i: fp for i, (fp, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == brute_components(fps, 3)
    assert simhash_bk.near_groups(documents(spark, ["a"]).where("false")).count() == 0


def flipped(rng, fp, most):
    for b in rng.sample(range(64), rng.randrange(most + 1)):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize(("shard", "most"), [(1024, 8192), (64, 400), (20, 40), (4, 10), (1, 4)])
def test_hot_buckets_and_small_shards_lose_no_link(spark, shard, most):
    """A third of all fingerprints are near one another; chains and clusters beside them, and near pairs at distances 3 and 4."""
    rng = random.Random(7)
    centre, fps = rng.getrandbits(64), [0, 7, (1 << 64) - 1]
    fps += [flipped(rng, centre, 3) for _ in range(120)] + [flipped(rng, centre, 9) for _ in range(40)]
    for _ in range(50):
        base = rng.getrandbits(64)
        fps += [base, flipped(rng, base, 3), flipped(rng, base, 5)]
    chain = rng.getrandbits(64)
    for _ in range(30):
        chain = flipped(rng, chain, 3)
        fps.append(chain)
    fps = sorted(set(fps))
    distinct = spark.createDataFrame([(bytearray(x.to_bytes(8, "little")),) for x in fps], "fp binary")
    got = {int.from_bytes(r.fp, "little"): bytes(r.root) for r in simhash_bk.grouped(distinct, 64, 3, shard, most).collect()}
    want = brute_components(dict(enumerate(fps)), 3)
    pairs = {(got[fps[i]], c) for i, c in want.items()}
    assert len(got) == len(fps) and len(pairs) == len(set(got.values())) == len(set(want.values()))


def test_tables_read_what_the_number_of_fingerprints_needs():
    width = lambda n: [len(t) for t in simhash_bk.exact_tables(64, 3, n)]
    assert width(1000) == [0] and width(4096) == [2] * 4 and width(60_000_000) == [16] * 4
    assert len(width(10**9)) == 10 and min(width(10**9)) == 20 and len(width(10**13)) == 35


def test_trees_prune():
    """Shards are large enough for the search to follow few of a tree's edges."""
    items = np.random.default_rng(3).integers(0, 2**63, (4096, 1), dtype=np.uint64)
    forest = bktree.Forest(items, np.arange(0, 4096, 1024))
    assert list(forest.pairs(3)) == []
    assert forest.visited < 0.35 * 4096 * 1024


def test_hubs_are_not_gathered(spark):
    """A hub with most of the links, and others joined to it, give one component each."""
    links = [(k, 10_000 + k % 7) for k in range(3000)] + [(20_000 + k, 1) for k in range(2500)] + [(30_000, 30_001)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = brute_links(links)
    assert got == {x: r for x, r in want.items() if x != r}


def brute_links(links):
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_long_texts_count_every_shingle():
    text = " ".join(f"t{k % 977}" for k in range(40_000))
    hashes = simhash_bk.shingle_hashes(text.encode(), 3, 42)
    ones = sum((hashes >> np.uint64(b) & np.uint64(1)).sum() * 2 > len(hashes) and 1 << b for b in range(64))
    assert int.from_bytes(simhash_bk.fingerprint(hashes, 1), "little") == ones


@pytest.mark.parametrize("width", [1, 2])
def test_forest_finds_all_pairs(width):
    rng = np.random.default_rng(1)
    items = np.repeat(rng.integers(0, 2**63, (20, width), dtype=np.uint64), 20, axis=0)
    for k in range(len(items)):
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            items[k, 0] ^= np.uint64(1) << np.uint64(b)
    starts = np.array([0, 90, 91, 300])
    bucket = np.searchsorted(starts, np.arange(len(items)), "right")
    want = {(i, j) for i in range(len(items)) for j in range(i) if bucket[i] == bucket[j] and bktree.distance(items[i : i + 1], items[j : j + 1])[0] <= 3}
    got = [p for i, j in bktree.Forest(items, starts).pairs(3) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(0, k) for k in range(1, 60)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(101, 141)) and all(got[k] == 0 for k in range(1, 60)) and got[501] == 500
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b):
    sets = [{tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_keep_one_catches_similar_texts_and_leaves_others(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts, family = [], []
    for f in range(60):
        base = [rng.choice(vocabulary) for _ in range(250)]
        for n in range(3):
            own = list(base)
            for _ in range(4 * n):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
            family.append(f)
    pairs = [(k, k + n) for k in range(0, len(texts), 3) for n in (1, 2) if jaccard(texts[k], texts[k + n]) >= 0.8]
    docs = documents(spark, texts + AWKWARD[3:])
    kept = simhash_bk.keep_one(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    assert len(pairs) >= 40 and sum(b in ids for _, b in pairs) <= 0.05 * len(pairs)
    assert {family[i] for i in ids if i < len(texts)} == set(family)
    assert {k for k in range(0, len(texts), 3)} <= ids
