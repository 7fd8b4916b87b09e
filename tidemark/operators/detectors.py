"""Detectors plug in as column builders; their category scores are merged per frame."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import CLASSES, SCREENED_BY_DEFAULT, Policy
from tidemark.functions.scoring import combined, frame_score, softmax, unscreened


class Detector(Protocol):
    id: str
    categories: Sequence[str]

    def scores(self, policy: Policy) -> Column:
        """map<string, double>; a category that was not screened is absent."""

    def detail(self) -> Column | None:
        """Class scores as a struct, if the detector has them."""


class ClassDetector:
    """Sexual content from the five class scores."""

    id, categories = "classes", SCREENED_BY_DEFAULT

    def __init__(self, classes: str = "classes"):
        self.classes = classes

    def scores(self, policy: Policy) -> Column:
        return F.create_map(F.lit("sexual"), frame_score(F.col(self.classes), policy))

    def detail(self) -> Column:
        return F.col(self.classes)


class LogitDetector:
    """One category from a position of softmaxed logits; no logits give an empty map."""

    id = "logits"

    def __init__(self, logits: str = "logits", index: int = 1, category: str = "violence"):
        self.logits, self.index, self.categories = logits, index, (category,)

    def scores(self, policy: Policy) -> Column:
        value = F.try_element_at(softmax(F.col(self.logits)), F.lit(self.index + 1))
        return F.when(value.isNotNull(), F.create_map(F.lit(self.categories[0]), value)).otherwise(_empty())

    def detail(self) -> None:
        return None


def _empty() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))


def merged(maps: Sequence[Column]) -> Column:
    """The highest score per category over detectors; NaN is left out, nothing gives an empty map."""
    clean = [F.map_filter(F.coalesce(m, _empty()), lambda k, v: v.isNotNull() & ~F.isnan(v)) for m in maps]
    return reduce(lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y)), clean, _empty()) if clean else _empty()


def detect(frames: DataFrame, detectors: Sequence[Detector], policy: Policy) -> DataFrame:
    """frames with categories, score, classes (the first detector's detail, else all Neutral), screened and unscreened."""
    neutral = F.struct(*[F.lit(1.0 if c == "Neutral" else 0.0).alias(c) for c in CLASSES])
    details = [d.detail() for d in detectors]
    rows = frames.withColumn("categories", merged([d.scores(policy) for d in detectors]))
    screened = F.array_distinct(F.array(*[F.lit(c) for d in detectors for c in d.categories])) if detectors else F.array().cast("array<string>")
    return (
        rows.withColumn("score", combined(F.col("categories")))
        .withColumn("classes", F.coalesce(*[d for d in details if d is not None], neutral))
        .withColumn("screened", screened)
        .withColumn("unscreened", unscreened(F.col("screened")))
    )


def classify(frames: DataFrame, load, column: str = "pixels") -> DataFrame:
    """frames with classes from a model: load() is called once per task and gives a function from a batch (a Series) to rows of five."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield batch.assign(classes=[dict(zip(CLASSES, map(float, row), strict=True)) for row in model(batch[column])])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    return frames.mapInPandas(run, f"{columns}, classes struct<{','.join(f'{c}:double' for c in CLASSES)}>")


def merge_rows(results: DataFrame, key: str = "frame_id") -> DataFrame:
    """Detector rows (key, detector_order, categories) -> key, categories: merged by an aggregation instead of by columns."""
    rows = results.select(key, F.explode("categories").alias("category", "score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    peaks = rows.groupBy(key, "category").agg(F.max("score").alias("score"))
    found = peaks.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "score")))).alias("categories"))
    return results.select(key).distinct().join(found, key, "left").select(key, F.coalesce("categories", _empty()).alias("categories"))


def fit_for_use(logits: DataFrame, least_swing: float = 4.0, least_ratio: float = 0.67) -> DataFrame:
    """Whether a two-class model tells images apart: swing of its logits and how often it wins on clean images (is_clean)."""
    swing = F.max(F.col("logits")[1]) - F.min(F.col("logits")[1])
    wins = F.count_if(F.col("is_clean") & (F.col("logits")[0] > F.col("logits")[1]))
    clean = F.count_if("is_clean")
    ratio = F.when(clean > 0, wins / clean).otherwise(F.lit(0.0))
    return logits.agg(swing.alias("swing"), ratio.alias("ratio")).withColumn("fit", (F.col("swing") >= least_swing) & (F.col("ratio") >= least_ratio))
