import math

import pytest
from pyspark.sql import functions as F

from tidemark.constants import CLASSES, POLICIES
from tidemark.functions import scoring


def classes(**own):
    return F.struct(*[F.lit(float(own.get(c, 0.0))).alias(c) for c in CLASSES])


def test_clamp_keeps_nan(value):
    assert math.isnan(value(scoring.clamp01(F.lit(float("nan")))))
    assert value(scoring.clamp01(F.lit(-3.0))) == 0
    assert value(scoring.clamp01(F.lit(5.0))) == 1
    assert value(scoring.clamp01(F.lit(0.25))) == 0.25


@pytest.mark.parametrize(("x", "digits", "expected"), [(1.005, 2, 1.0), (-2.5, 0, -2.0), (2.5, 0, 3.0)])
def test_rounding_is_half_up(value, x, digits, expected):
    assert value(scoring.round_to(F.lit(x), digits)) == math.floor(x * 10**digits + 0.5) / 10**digits
    assert expected - value(scoring.round_to(F.lit(x), digits)) in (0.0, pytest.approx(-0.01))


@pytest.mark.parametrize("policy", POLICIES.values(), ids=POLICIES)
def test_frame_score_extremes(value, policy):
    assert value(scoring.frame_score(classes(Neutral=1), policy)) == 0
    assert value(scoring.frame_score(classes(Porn=1), policy)) == 1


def test_stricter_policies_score_higher(value):
    scores = [value(scoring.frame_score(classes(Neutral=0.2, Sexy=0.8), p)) for p in POLICIES.values()]
    assert scores == sorted(scores, reverse=True) and len(set(scores)) == 3


def test_class_struct_wants_five(value):
    assert value(scoring.class_struct(F.array(*[F.lit(x / 10) for x in range(5)]))).Porn == 0.3
    with pytest.raises(Exception, match="expected 5"):
        value(scoring.class_struct(F.array(F.lit(0.1))))


def test_predictions_by_name(value):
    rows = F.array(*[F.struct(F.lit(n).alias("className"), F.lit(p).alias("probability")) for n, p in (("Porn", 0.2), ("Other", 0.9), ("Porn", 0.4))])
    got = value(scoring.class_struct_of(rows))
    assert (got.Porn, got.Sexy) == (0.4, 0.0)


def test_dominant_class_ties_go_to_the_first(value):
    assert value(scoring.dominant_class(classes(Neutral=0.5, Porn=0.5))) == "Neutral"
    assert value(scoring.dominant_class(classes(Sexy=0.9, Porn=0.5))) == "Sexy"


def test_merged_crops(value):
    got = value(scoring.merged_crops(F.array(classes(Porn=0.2, Sexy=0.5), classes(Porn=0.7))))
    assert (got.Porn, got.Sexy, got.Neutral) == (0.7, 0.5, 0.0)
    with pytest.raises(Exception, match="no crops"):
        value(scoring.merged_crops(F.filter(F.array(classes()), lambda _: F.lit(False))))


def test_combined(value):
    def of(weights=None, **scores):
        m = F.create_map(*[x for k, v in scores.items() for x in (F.lit(k), F.lit(float(v)))]) if scores else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
        return value(scoring.combined(m, weights))

    assert of() == 0
    assert of(sexual=0.05, violence=0.9) == 0.9
    assert (of(sexual=5), of(sexual=-3)) == (1, 0)
    assert of(sexual=float("nan"), violence=0.7) == 0.7
    assert of({"sexual": 0.5}, sexual=0.8) == 0.4
    assert of({"violence": 0}, violence=1, sexual=0.1) == 0.1


def test_softmax(value):
    got = value(scoring.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert got == [0.5, 0.5]
    assert sum(value(scoring.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(-4.0))))) == pytest.approx(1)


def test_confidences(value):
    p = POLICIES["balanced"]
    assert value(scoring.negative_confidence(F.lit(0.0), F.lit(0.01), p)) == pytest.approx(0.5 + 0.5 * (0.4 + 0.6 * 0.01))
    assert value(scoring.negative_confidence(F.lit(0.0), F.lit(1.0), p)) == 0.99
    for s in (0.0, 0.3, 0.6, 1.0):
        for n in (0, 1, 5):
            assert 0.5 <= value(scoring.positive_confidence(F.lit(s), F.lit(n), p)) <= 0.99


def test_planes_and_probability(value):
    rgba = F.array(*[F.lit(x) for x in (255, 0, 255, 255, 0, 255, 0, 255)])
    assert value(scoring.normalised_planes(rgba, F.lit(2), F.lit(1), [0.5] * 3, [0.5] * 3)) == [1.0, -1.0, -1.0, 1.0, 1.0, -1.0]
    assert value(scoring.hit_probability(F.lit(16), F.lit(10.0), F.lit(600.0))) == pytest.approx(16 / 60)
