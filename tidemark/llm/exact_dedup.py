"""Exact dedup by skew-safe combining.

Copies are combined three times, and each time rows meet only if their whole normalised texts are equal; the digest
merely leads them to the same place:

1. locally, in the map side of the first aggregation;
2. per (digest, salt): a digest of more than `group_limit` rows is spread over as many salts as keep its salted groups about that size,
   by the rows' own numbers, so that null or repeated ids spread, too; any other digest has one salt;
3. per digest, over what the salts kept: the winners meet alone, and the winner of all of them goes back to the salts, where
   the rows are.

The limit is the square root of the rows. So of a group of a third of all rows no task of step 2 has more than about that many,
and step 3 moves one row per salt. Digests above the limit are counted first, from digests alone; they are fewer than
FEW by the limit's definition, and broadcast. Texts of all other digests are shuffled once.

Defined cases: a null text counts as empty; an empty table gives an empty result; rows that repeat a doc_id are rows of
their own, and exactly one row of each group is kept; a null doc_id comes after all others; extra columns are ignored
by `exact_groups` and carried through by `keep_first`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import WHITE, cut

#: Digests that may be broadcast.
FEW = 10_000


def group_limit(rows: int) -> int:
    """Rows of a salted group, about: fewer than FEW digests can have more."""
    return max(8, math.isqrt(rows), math.ceil(rows / FEW))


def _normal(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def _digest(norm: Column | str, bits: int) -> Column:
    return F.substring(F.sha2(norm, 256), 1, bits // 4)


def hot_digests(docs: DataFrame, text_col: str, bits: int = 256) -> DataFrame:
    """digest, salts (checkpointed) of the digests above the limit."""
    counts = docs.select(_digest(_normal(F.col(text_col)), bits).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))
    limit = group_limit(docs.count())
    return cut(counts.where(F.col("n") > limit).select("digest", F.ceil(F.col("n") / limit).cast("int").alias("salts")))


def _keyed(docs: DataFrame, text_col: str, id_col: str, bits: int, hot: DataFrame, carried: list) -> tuple[DataFrame, DataFrame]:
    """norm, place, digest and what is carried, of the rows with one salt; and with a salt of the others."""
    text, ident = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col)
    rows = docs.select(
        _normal(F.col(text_col)).alias("norm"),
        F.struct((-F.length(text)).alias("points"), ident.isNull().alias("no_id"), ident.alias("id")).alias("place"),
        F.xxhash64(F.monotonically_increasing_id()).alias("number"),
        *carried,
    ).withColumn("digest", _digest("norm", bits))
    hot = F.broadcast(hot)
    return rows.drop("number").join(hot, "digest", "left_anti"), rows.join(hot, "digest").withColumn("salt", F.pmod("number", "salts")).drop("number", "salts")


def _places(rows: DataFrame, *keys: str) -> DataFrame:
    """Per group: places in order."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("place")).alias("places"))


def salted_groups(rows: DataFrame) -> DataFrame:
    """digest, norm, places (of a salt's rows), keep, group_size, first (whether the winner of all is theirs): of rows with salts, every salt."""
    salted = cut(_places(rows, "digest", "salt", "norm"))  # a text and its places per salt
    best = F.struct(F.element_at("places", 1).alias("place"), "salt")
    winners = salted.groupBy("digest", "norm").agg(F.min(best).alias("best"), F.sum(F.size("places")).alias("group_size"), F.collect_set("salt").alias("salts"))
    dealt = winners.select("digest", "norm", F.col("best.place").alias("keep"), "group_size", F.col("best.salt").alias("first"), F.explode("salts").alias("salt"))
    return salted.join(dealt, ["digest", "salt", "norm"]).withColumn("first", F.col("first") == F.col("salt")).drop("salt")


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", digest_bits: int = 256) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. Fewer digest_bits give the same groups."""
    hot = hot_digests(docs, text_col, digest_bits)
    few, many = _keyed(docs, text_col, id_col, digest_bits, hot, [])
    groups = _places(few, "digest", "norm").select("digest", "norm", "places", F.element_at("places", 1).alias("keep"), F.size("places").cast("long").alias("group_size"), F.lit(True).alias("first"))
    if not hot.isEmpty():
        groups = groups.unionByName(salted_groups(many))
    whole = F.col("digest") if digest_bits == 256 else F.sha2("norm", 256)
    rows = groups.select(whole.alias("text_sha256"), "keep", "group_size", "first", F.posexplode("places").alias("at", "place"))
    return rows.select(
        F.col("place.id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("first") & (F.col("at") == 0)).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns: the same combining steps carry whole rows."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    best = (F.min_by("whole", "place").alias("whole"), F.min("place").alias("place"))
    hot = hot_digests(docs, text_col)
    few, many = _keyed(docs, text_col, id_col, 256, hot, [whole])
    kept = few.groupBy("digest", "norm").agg(*best).select("whole.*")
    if hot.isEmpty():
        return kept
    salted = many.groupBy("digest", "salt", "norm").agg(*best)
    return kept.unionByName(salted.groupBy("digest", "norm").agg(*best).select("whole.*"))
