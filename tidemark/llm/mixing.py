"""Mixing sources to target weights by Poisson replication.

A source s with a share t_s of the wanted mixture and c_s of the corpus' characters is repeated t_s * C / c_s times on
average (C: all characters). Each document's number of copies is the inverse of the Poisson distribution with that mean
at a number in [0, 1) that a seeded hash of the document gives: the smallest k whose cumulative probability exceeds it.
So runs agree, documents are drawn independently, and no source needs to be gathered anywhere. The copies are dealt to
partitions by a second hash and ordered by it there, which is a global shuffle.

The means are one number per source. Up to MAX_BROADCAST sources they are broadcast; beyond it the same rows are joined on
(source, salt). The inverse is taken from the probabilities around the mean, up to a mean of LARGE, and beyond it from
the asymptotic expansion of the distribution, so neither needs memory that grows with the mean. A document with more than
BLOCK copies is dealt in blocks of copies before they are made.

Defined cases: a null source is the source ''; a source without a target weight keeps its own share of the corpus
(so a mean of one before the weights are scaled to one); an empty text counts as one character; a weight of zero drops its source; an empty
table gives an empty result; rows that repeat a doc_id are told apart by their text, and rows equal in both are drawn alike; all columns
are carried through, and an added column whose name clashes with one of them gets a trailing underscore.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut

MAX_BROADCAST = 10_000
SALTS = 64
BITS = 48
#: Above this mean the distribution comes from its asymptotic expansion.
LARGE = 10_000.0
#: Copies of a document that one task makes at once, at most.
BLOCK = 1024


def means(sizes: dict[str, int], targets: dict[str, float] | None) -> dict[str, float]:
    """Mean repetitions per source. targets None: an equal share for every source."""
    total = sum(sizes.values())
    if targets is None:
        weights = dict.fromkeys(sizes, 1.0)
    else:
        weights = {s: targets.get(s, n / total) for s, n in sizes.items()}
    scale = sum(weights.values())
    return {s: weights[s] / scale * total / n if scale else 0.0 for s, n in sizes.items()}


def _table(mean: float) -> tuple[int, np.ndarray]:
    """The first k that a number of BITS bits can draw, about, and P(X <= k) from it on."""
    wide = 12 * math.sqrt(mean) + 40
    low, mode, high = max(0, int(mean - wide)), int(mean), int(mean + wide) + 1
    up = np.cumprod(mean / np.arange(mode + 1, high))
    down = np.cumprod(np.arange(mode, low, -1) / mean)
    below = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    return low, below / below[-1]


# Coefficients of the uniform asymptotic expansion of the incomplete gamma function (Temme, 1979), by powers
# of eta, for the powers 0, -1 and -2 of the parameter.
TEMME = [
    [-1 / 3, 1 / 12, -2 / 135, 1 / 864, 1 / 2835, -139 / 777600, 1 / 25515],
    [-1 / 540, -1 / 288, 1 / 378, -77 / 77760, 1 / 4860],
    [25 / 6048, -139 / 51840, 1 / 1296],
]


def _below(k: np.ndarray, mean: float) -> np.ndarray:
    """P(X <= k) for a large mean and k not far from it."""
    a = k + 1.0
    mu = (mean - a) / a
    series = mu**2 * (1 / 2 - mu * (1 / 3 - mu * (1 / 4 - mu * (1 / 5 - mu * (1 / 6 - mu * (1 / 7 - mu / 8))))))
    phi = np.where(np.abs(mu) < 0.01, series, mu - np.log1p(mu))
    eta = np.sign(mu) * np.sqrt(2 * phi)
    rest = sum(np.polynomial.polynomial.polyval(eta, c) / a**n for n, c in enumerate(TEMME))
    tail = np.array([math.erfc(x) for x in (eta * np.sqrt(a / 2)).tolist()]) / 2
    return tail + np.exp(-a * phi) / np.sqrt(2 * math.pi * a) * rest


def _large(mean: float, at: np.ndarray) -> np.ndarray:
    normal = NormalDist()
    z = np.array([normal.inv_cdf(min(max(u, 2.0**-60), 1 - 2.0**-53)) for u in at.tolist()])
    k = np.floor(mean + z * math.sqrt(mean) + (z**2 - 1) / 6)
    while (low := _below(k, mean) <= at).any():
        k += low
    while (high := _below(k - 1, mean) > at).any():
        k -= high
    return k


def inverse(mean: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The smallest k with P(X <= k) > at of Poisson distributions with these means, in memory that doesn't grow with them."""
    out = np.zeros(len(mean), dtype=np.int64)
    for m in np.unique(mean[mean > 0]):
        rows = np.flatnonzero(mean == m)
        if m > LARGE:
            out[rows] = _large(float(m), at[rows])
        else:
            low, below = _table(float(m))
            out[rows] = low + np.searchsorted(below, at[rows], "right")
    return out


def _draw(mean: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series(inverse(mean.to_numpy(), at.to_numpy()))


def unit(seed: int, *parts) -> F.Column:
    """A number in [0, 1) from the first 48 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts)), 1, BITS // 4), 16, 10).cast("double") / F.lit(float(2**BITS))


def mix(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    source_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    seed: int = 42,
    marks: bool = True,
) -> DataFrame:
    """docs with every document repeated by its draw, in shuffled order; marks adds copy, copies and mix_key."""
    spark, columns = docs.sparkSession, docs.columns
    free = lambda name: name if name.lower() not in {c.lower() for c in columns} else free(name + "_")
    copy, times, key, where, who, rate, salt, block = map(free, ("copy", "copies", "mix_key", "__mix_source", "__mix_doc", "__mix_mean", "__mix_salt", "__mix_block"))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    size = F.greatest(F.lit(1), F.coalesce(F.length(text_col), F.lit(1)))
    sizes = docs.groupBy(source.alias("s")).agg(F.sum(size).alias("n"))
    few = sizes.limit(MAX_BROADCAST + 1).collect()
    keyed = docs.withColumn(where, source).withColumn(
        who, F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    )
    if len(few) <= MAX_BROADCAST:
        found = means({r.s: r.n for r in few}, targets)
        most = max(found.values(), default=0.0)
        rates = spark.createDataFrame(list(found.items()), f"{where} string, {rate} double")
        joined = keyed.join(F.broadcast(rates), where)
    else:
        sizes = cut(sizes)
        total = sizes.agg(F.sum("n")).first()[0]
        weighted = sizes.withColumn("w", F.lit(1.0))
        if targets is not None:
            given = spark.createDataFrame(list(targets.items()), "s string, w double")
            weighted = sizes.join(given, "s", "left").select("s", "n", F.coalesce("w", F.col("n") / total).alias("w"))
        scale = weighted.agg(F.sum("w")).first()[0]
        rates = weighted.select(F.col("s").alias(where), (F.col("w") / scale * total / F.col("n") if scale else F.lit(0.0)).alias(rate))
        most = rates.agg(F.max(rate)).first()[0]
        rates = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn(salt, F.pmod(F.xxhash64(who), F.lit(SALTS)).cast("int")).join(rates, [where, salt])
    # called non-deterministic so that no task evaluates it twice, for the filter and for the column
    drawn = joined.withColumn(times, F.pandas_udf(_draw, "long").asNondeterministic()(F.col(rate), unit(seed, F.col(who)))).where(F.col(times) > 0)
    one = F.lit(1).cast("long")
    spread = drawn.withColumn(copy, F.explode(F.sequence(one, F.least(times, F.lit(BLOCK).cast("long")))))
    if most + 12 * math.sqrt(most) + 40 > BLOCK:
        # the further copies of a document with many of them are made by many tasks
        blocks = F.sequence(one, F.floor((F.col(times) - 1) / BLOCK).cast("long"))
        dealt = drawn.where(F.col(times) > BLOCK).withColumn(block, F.explode(blocks)).repartition(F.xxhash64(who, block))
        further = F.sequence(F.col(block) * BLOCK + 1, F.least(F.col(times), (F.col(block) + 1) * BLOCK))
        spread = spread.unionByName(dealt.withColumn(copy, F.explode(further)).drop(block))
    marked = spread.withColumn(key, F.md5(F.concat_ws("\x1f", F.lit(str(seed + 1)), F.col(who), F.col(copy))))
    own = [F.col(f"`{c}`") for c in columns]
    dealt = marked.select(*own, copy, times, key).repartition(F.col(key)).sortWithinPartitions(key)
    return dealt if marks else dealt.select(*own)
