import random

import numpy as np
import pytest
from tidemark.llm import near_sets, simhash_bk
from tidemark.llm.shingles import fingerprint
from tests.llm.helpers import documents, words


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} - {()}


def brute_kept(texts):
    """The least id of each component of the pairs of similarity 0.8 or more, all pairs compared."""
    sets, label = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if not sets[i] | sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if find(i) == i}


def edited(rng, base, edits):
    own = list(base)
    for _ in range(edits):
        own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
    return own


def texts_around_the_limit(families=40, each=5):
    rng = random.Random(5)
    out = []
    for _ in range(families):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((8, 30, 100, 250)))]
        out += [" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 25))) for _ in range(each)]
    return out


def kept(spark, texts):
    return {r.doc_id for r in simhash_bk.keep_one(documents(spark, texts)).collect()}


def test_kept_are_those_of_all_pairs(spark):
    texts = [*texts_around_the_limit(), None, "", " ", "one", "one two", "ONE  two"]
    rng = random.Random(6)
    line = [f"l{k}" for k in range(12)]
    # much of one line, else apart; and much of one line in one of two texts that are near as sets
    texts += [" ".join(line * 30 + [f"v{rng.randrange(4000)}" for _ in range(60)]) for _ in range(4)]
    body = [f"b{rng.randrange(4000)}" for _ in range(200)]
    texts += [" ".join(body), " ".join(body + line[:4] * 60)]
    want = brute_kept(texts)
    assert 20 < len(want) < len(texts) - 40
    assert kept(spark, texts) == want


@pytest.mark.parametrize(("block", "leaders"), [(4, 1), (7, 3)])
def test_large_buckets_in_blocks(spark, monkeypatch, block, leaders):
    monkeypatch.setattr(near_sets, "BLOCK", block)
    monkeypatch.setattr(near_sets, "LEADERS", leaders)
    rng = random.Random(8)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    texts = [" ".join(edited(rng, base, rng.randrange(0, 5))) for _ in range(60)] + texts_around_the_limit(4, 20)
    assert kept(spark, texts) == brute_kept(texts)


def test_a_group_gives_candidates_in_proportion(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(400)]
    docs = documents(spark, [" ".join(edited(rng, base, 1)) for _ in range(400)])
    nodes = near_sets.set_prints(docs, "text", "doc_id", 5, 512).dropDuplicates(["key"])
    members = near_sets.bucket_members(nodes).cache()
    pairs = near_sets.leader_pairs(members, 8, 132, 0.8).count()
    assert nodes.count() - 1 <= pairs <= near_sets.BANDS * near_sets.LEADERS * 400
    assert kept(spark, [r.text for r in docs.collect()]) == {0}


@pytest.mark.parametrize("size", [5, 10, 50, 300])
def test_joint_recall_at_the_least_similarity(size):
    rng = np.random.default_rng(size)
    tries, met = 500, 0
    for _ in range(tries):
        whole = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        part = np.sort(rng.permutation(whole)[: size * 4 // 5])
        a, b = (np.frombuffer(near_sets.bands(x), dtype="<i8") for x in (whole, part))
        x, y = (np.frombuffer(fingerprint(h, 8), dtype="<u8") for h in (whole, part))
        met += bool((a == b).any()) and int(np.bitwise_count(x ^ y).sum()) <= 132
    assert met >= 0.995 * tries, met
