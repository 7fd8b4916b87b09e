"""Column functions from class probabilities to scores and confidences."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.constants import BASE_PRIORITY, CATEGORIES, CLASSES, MAX_CONFIDENCE, Policy


def clamp01(x: Column) -> Column:
    """x within [0, 1]; NaN stays NaN, although Spark orders it above every number."""
    return F.when(F.isnan(x), x).when(x < 0, F.lit(0.0)).when(x > 1, F.lit(1.0)).otherwise(x)


def half_up(x: Column) -> Column:
    """The nearest integer, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def round_to(x: Column, digits: int) -> Column:
    unit = float(10**digits)
    return half_up(x * unit) / F.lit(unit)


def class_struct(vector: Column) -> Column:
    """A vector in the order of CLASSES as a struct; any other length is an error."""
    checked = F.when(F.size(vector) == len(CLASSES), vector).otherwise(F.raise_error(F.lit(f"expected {len(CLASSES)} class scores")))
    return F.struct(*[checked[k].alias(c) for k, c in enumerate(CLASSES)])


def class_struct_of(predictions: Column) -> Column:
    """array<struct<className, probability>> as a struct: unknown names are left out, the last of a name counts, else 0."""

    def last(name: str) -> Column:
        found = F.filter(predictions, lambda p: p["className"] == name)
        return F.coalesce(F.try_element_at(found, F.lit(-1))["probability"], F.lit(0.0))

    return F.struct(*[last(c).alias(c) for c in CLASSES])


def frame_score(classes: Column, policy: Policy) -> Column:
    """The policy-weighted sum of class scores, clamped; a missing class counts as 0."""
    total = F.lit(0.0)
    for name, weight in zip(CLASSES, policy.weights, strict=True):
        total = total + F.coalesce(classes[name], F.lit(0.0)) * F.lit(weight)
    return clamp01(total)


def dominant_class(classes: Column) -> Column:
    """The class of the highest score, the first in the order of CLASSES on a tie."""
    values = F.array(*[classes[c] for c in CLASSES])
    return F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.array_position(values, F.array_max(values)).cast("int"))


def merged_crops(crops: Column) -> Column:
    """array of class structs -> the highest value per class, 0 at least; an empty array is an error."""
    some = F.when(F.size(crops) > 0, crops).otherwise(F.raise_error(F.lit("no crops to merge")))

    def highest(name: str) -> Column:
        return F.greatest(F.lit(0.0), F.array_max(F.transform(some, lambda s: s[name])))

    return F.struct(*[highest(c).alias(c) for c in CLASSES])


def combined(categories: Column, weights: Mapping[str, float] | None = None) -> Column:
    """The highest weighted category score; NaN is left out, a category without a weight has weight 1, nothing gives 0."""
    known = F.filter(F.map_entries(categories), lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]))
    weight = F.create_map(*[F.lit(x) for k, w in (weights or {}).items() for x in (k, float(w))]) if weights else None

    def scored(e: Column) -> Column:
        own = F.coalesce(F.try_element_at(weight, e["key"]), F.lit(1.0)) if weight is not None else F.lit(1.0)
        return clamp01(e["value"]) * clamp01(own)

    return F.coalesce(F.array_max(F.transform(known, scored)), F.lit(0.0))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / F.when(total == 0, F.lit(1.0)).otherwise(total))


def normalised_planes(rgba: Column, width: Column, height: Column, mean: list[float], std: list[float]) -> Column:
    """RGBA bytes as three planes of (x / 255 - mean) / std, red first."""
    pixels = F.sequence(F.lit(0), width * height - 1)
    plane = lambda k: F.transform(pixels, lambda p: (F.get(rgba, p * 4 + k) / 255.0 - mean[k]) / std[k])
    return F.concat(plane(0), plane(1), plane(2))


def positive_confidence(top_mean: Column, independent: Column, policy: Policy) -> Column:
    strength = clamp01((top_mean - policy.frame_threshold) / max(1e-6, 1 - policy.frame_threshold))
    persistence = clamp01(independent / F.lit(float(max(1, policy.min_flagged))))
    return F.least(F.lit(MAX_CONFIDENCE), 0.5 + 0.5 * clamp01(0.7 * strength + 0.3 * persistence))


def negative_confidence(top: Column, coverage: Column, policy: Policy) -> Column:
    margin = 1 - clamp01(top / max(1e-6, policy.frame_threshold))
    return F.least(F.lit(MAX_CONFIDENCE), 0.5 + 0.5 * margin * (0.4 + 0.6 * clamp01(coverage)))


def interval_priority(span_ms: Column, score_a: Column, score_b: Column, min_gap_ms: Column) -> Column:
    return (F.lit(BASE_PRIORITY) + F.greatest(score_a, score_b)) * F.log2(1 + span_ms / min_gap_ms)


def hit_probability(samples: Column, span: Column, duration: Column) -> Column:
    """How likely evenly spread samples meet a span."""
    return F.least(F.lit(1.0), samples * span / duration)


def unscreened(screened: Column) -> Column:
    return F.array_except(F.array(*[F.lit(c) for c in CATEGORIES]), screened)
