import hashlib

import pytest
from pyspark.sql import functions as F
from tidemark.llm import exact_dedup
from tests.llm.helpers import AWKWARD, WHITE, documents


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g}


@pytest.mark.parametrize("bits", [256, 4])
def test_groups_match_brute_force(spark, bits):
    texts = AWKWARD * 3 + ["hot copy"] * 200 + ["hot  copy "] * 100
    got = exact_dedup.exact_groups(documents(spark, texts), digest_bits=bits).collect()
    want = brute(list(enumerate(texts)))
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got}
    assert found == {i: w[:3] for i, w in want.items()} and len(got) == len(texts)
    assert {r.doc_id: r.text_sha256 for r in got} == {i: w[3] for i, w in want.items()}


def test_repeated_and_null_ids(spark):
    docs = documents(spark, ["a", "a", "a", "b"], [7, 7, None, None])
    got = exact_dedup.exact_groups(docs).collect()
    assert sum(r.kept for r in got) == 2 and {r.keep_id for r in got if r.group_size == 3} == {7}
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0


def test_keep_first_keeps_whole_rows(spark):
    texts = AWKWARD + ["hot"] * 50
    docs = documents(spark, texts)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {w[0] for w in brute(list(enumerate(texts))).values()}


@pytest.mark.parametrize("ids", ["own", "null", "repeated"])
def test_a_hot_group_meets_in_no_task(spark, ids):
    """A third of all rows are equal: no salted group has many more than the square root of the rows, and winners are one row a salt."""
    n = 30_000
    number = F.col("id") if ids == "own" else F.lit(None).cast("long") if ids == "null" else F.col("id") % 5
    docs = spark.range(n, numPartitions=6).select(number.alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    hot = exact_dedup.hot_digests(docs, "text")
    assert [r.salts for r in hot.collect()] == [-(-n // 3 // exact_dedup.group_limit(n))]
    _, many = exact_dedup._keyed(docs, "text", "doc_id", 256, hot, [])
    salted = exact_dedup.salted_groups(many)
    sizes = [r.n for r in salted.select(F.size("places").alias("n")).collect()]
    assert sum(sizes) == n // 3 and max(sizes) < 1.5 * n**0.5
    got = exact_dedup.exact_groups(docs).where("group_size > 1").agg(F.count("*").alias("rows"), F.sum(F.col("kept").cast("int")).alias("kept"), F.min("group_size").alias("least"), F.max("group_size").alias("most")).first()
    assert tuple(got) == (n // 3, 1, n // 3, n // 3)
    assert exact_dedup.keep_first(docs).where("text = 'hot'").count() == 1
