import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import countmin, prefix_trie
from tidemark.llm.hot_join import join_hot

SCHEMA = "conv_id long, turn long, role string, text string, depth string, digest int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "ends_sha256"]


def brute(rows, borrow=True):
    """Nodes by walking every prefix of every conversation."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if borrow else 0
        built[c] = own.get(c - (abs(c) % 100) * (1 if c > 0 else -1), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, who in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[:-1] == m for x in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = sorted(c for c in who if len(built[c]) == len(node))
        out.add((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids), len(leaves), saved, len(ends), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def made(spark, rows, width=None, borrow=True):
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    c = F.col("conv_id")
    given = {"base": c - c % 100, "head": F.crc32(c.cast("string")) % 6} if borrow else {}
    found = [tuple(r) for r in prefix_trie.nodes(prefix_trie.prefixes(table, **given), width).select(*COLUMNS).collect()]
    assert len(found) == len(set(found))
    return set(found)


def conversations(seed, convs=60, hot=20):
    """Few different turns, so that prefixes branch everywhere; a hot conversation repeated; ids of both signs; gaps, nulls and ties."""
    r = random.Random(seed)
    rows = []
    for c in r.sample([*range(-120, 400), 1000, 5_000_000_000], convs):
        for turn in range(r.choice([1, 2, 3, 7])):
            rows.append((c, None if r.random() < 0.05 else turn // 2 if r.random() < 0.1 else turn, r.choice(["user", None, "", "é"]), r.choice(["a", "b", None, "", "x" * 30, "𝒳y"]), "own", 1))
    for c in range(700, 700 + hot):
        rows += [(c, t, "user", "same", "own", 1) for t in range(9)]
    rows += [(None, 0, "user", "nobody's", "own", 1)] + rows[:3]
    return rows


@pytest.mark.parametrize("width", [None, 8, 64])
def test_nodes_equal_a_walk_over_every_prefix(spark, width):
    rows = conversations(1 if width is None else width)
    assert made(spark, rows, width) == brute(rows)


def test_without_borrowed_turns_and_very_long_conversations(spark):
    rows = [(1, t, "user", str(t), "own", 1) for t in range(3000)] + [(2, t, "user", str(t), "own", 1) for t in range(2999)] + [(3, 0, "user", "0" * 50_000, "own", 1)]
    found = made(spark, rows, borrow=False)
    assert len(found) == 3002
    assert {x[:6] for x in found if x[1] == 0} == {(1, 0, None, 3, 2, 2)}
    assert next(x for x in found if x[:2] == (1, 3000))[2:] == (1, 1, 0, 1, 0, 1, hashlib.sha256(b"1").hexdigest())
    assert next(x for x in found if x[:2] == (1, 2999))[7:] == (1, hashlib.sha256(b"2").hexdigest())
    assert next(x for x in found if x[1] == 0)[6] == sum(len(str(t)) for t in range(2999))


def test_ids_that_end_in_a_node_are_hashed_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, 0, "user", "same", "own", 1) for c in range(100, 400)]
    assert made(spark, rows, borrow=False) == brute(rows, borrow=False)


def test_no_rows_no_nodes(spark):
    assert made(spark, []) == set()
    assert made(spark, [(None, 1, "user", "x", "own", 1)]) == set()


def test_tails_are_not_shuffled(spark):
    rows = [(c, t, "user", f"{c} {t}" if t else "hello", "own", 1) for c in range(500) for t in range(6)]
    table = spark.createDataFrame(rows, SCHEMA)
    prefixes = prefix_trie.cut(prefix_trie.prefixes(table))
    marked = prefix_trie.screened(prefixes, countmin.width_for(prefixes.count()))
    shared = marked.where("NOT single").groupBy("depth").count().collect()
    by_depth = {r["depth"]: r["count"] for r in shared}
    assert by_depth[0] == by_depth[1] == 500 and sum(v for d, v in by_depth.items() if d > 1) < 25


@pytest.mark.parametrize("width", [4096, 1 << 19])
def test_an_estimate_of_one_is_never_wrong(spark, width):
    digests = [hashlib.blake2b(str(k % 3000).encode(), digest_size=16).digest() for k in range(4000)]
    table = spark.createDataFrame([(d,) for d in digests], "digest binary").repartition(6)
    again = countmin.counted(table, width)
    single = countmin.proven_single(again, countmin.cells(digests, width))
    times = [digests.count(d) for d in digests]
    assert not any(s and n > 1 for s, n in zip(single, times, strict=True))
    lone = [s for s, n in zip(single, times, strict=True) if n == 1]
    assert sum(lone) > 0.4 * len(lone)


def test_hot_keys_join_by_broadcast_and_all_rows_stay(spark):
    rows = spark.createDataFrame([(1, k) for k in range(300)] + [(k, k) for k in range(2, 60)] + [(None, 7), (99, 8)], "key int, v int")
    named = spark.createDataFrame([(k, f"n{k}", 300 if k == 1 else 1) for k in range(1, 60)], "key int, name string, times long")
    found = join_hot(rows, named, "key", "times", few=10)
    assert sorted((r.key or 0, r.v, r.name) for r in found.collect()) == sorted([(1, k, "n1") for k in range(300)] + [(k, k, f"n{k}") for k in range(2, 60)] + [(0, 7, None), (99, 8, None)], key=lambda x: x[:2])
