"""Connected components of links by alternating large-star and small-star steps on DataFrames.

Each round gives every node the least node of its neighbourhood, first over its larger, then over its smaller
neighbours. Minima are pre-aggregated in the map tasks, so a hub's links never meet in one group; the joins that bring a
hub's minimum back to its links are plain equi-joins, which adaptive execution splits. Rounds are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut


def _mark(links: DataFrame) -> tuple:
    # sums of halves of a hash, so that they can't overflow
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b) -> (node, root), root the least node of its component; only nodes with a link to another appear."""
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(links)
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small, "a")
        links = cut(
            star.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        before, mark = mark, _mark(links)
        if mark == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
