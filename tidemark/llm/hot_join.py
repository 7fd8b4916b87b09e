"""An equi-join whose one side may repeat a key as often as it likes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that may be broadcast.
FEW = 10_000


def join_hot(rows: DataFrame, named: DataFrame, key: str, weight: str, few: int = FEW) -> DataFrame:
    """rows with the columns of named (one row per key), null where named has no such key; null keys find nothing.

    weight, a column of named, says how many rows its key may have. Keys above total / few are fewer than `few` by that
    count, whatever the data: those are broadcast to where their rows lie. All others meet by a plain join, in which no
    key has more than total / few rows. named is read three times: pass a checkpointed one.
    """
    total = named.agg(F.sum(weight)).first()[0] or 0
    limit = F.lit(math.ceil(total / few))
    others = [c for c in named.columns if c not in (key, weight)]
    heavy = named.where((F.col(weight) > limit) & (F.col(weight) > 1)).select(key, F.struct(*others).alias("_hot"))
    light = named.where((F.col(weight) <= limit) | (F.col(weight) <= 1)).select(key, *others)
    marked = rows.join(F.broadcast(heavy), key, "left")
    hot = marked.where("_hot IS NOT NULL").select(*rows.columns, "_hot.*")
    return hot.unionByName(marked.where("_hot IS NULL").drop("_hot").join(light, key, "left"))
