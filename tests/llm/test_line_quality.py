import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from tidemark.llm import crf, line_quality
from tests.llm.helpers import AWKWARD, documents


def test_marginals_match_all_labellings():
    rng = np.random.default_rng(2)
    lines = np.array([3, 1, 5])
    good, moves = rng.normal(0, 1, 9), rng.normal(0, 1, (2, 2))
    got, expected = crf.marginals(good, moves, lines)
    at, total = 0, np.zeros((2, 2))
    for n in lines:
        weights, ones, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(good[at + k] for k in range(n) if y[k]) + sum(moves[y[k], y[k + 1]] for k in range(n - 1)))
            weights += w
            ones += w * np.array(y)
            for k in range(n - 1):
                pairs[y[k], y[k + 1]] += w
        assert got[at : at + n] == pytest.approx(ones / weights)
        total += pairs / weights
        at += n
    assert expected == pytest.approx(total)


def test_line_features_by_hand():
    texts = ["One two two\nX!! Y!!\n", "", "É É", "\n"]
    made, sizes, lines = line_quality.line_features(pa.array([t.encode() for t in texts], pa.binary()))
    assert lines.tolist() == [3, 1, 1, 2] and sizes.tolist() == [12, 8, 0, 0, 3, 1, 0]
    assert made[0, 15] == pytest.approx(2 / 3) and made[0, 19] == pytest.approx(1 / 3)  # distinct words, words said again
    assert made[1, 2] == 1 and made[1, 7] == 2 and made[4, 2] == 1  # capitals, shouts, capitals beyond ASCII


def corpus(spark):
    rng = random.Random(5)
    good = lambda: "\n".join(" ".join(rng.choice("the of and a in to it is was on".split()) + f" w{rng.randrange(400)}" for _ in range(15)).capitalize() + "." for _ in range(4))
    bad = [lambda: "\n".join(" ".join(f"W{rng.randrange(400)}!!" for _ in range(30)) for _ in range(3)), lambda: " ".join(["Der"] * rng.randrange(40, 200)), lambda: " ".join(f"w{rng.randrange(400)}###" for _ in range(80))]
    texts = [good() if k % 5 else rng.choice(bad)() for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(400)] + [(None, 0), (3, None)], "doc_id long, quality int")
    return documents(spark, texts + AWKWARD), labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    rows = line_quality.score(docs, labels).collect()
    assert len(rows) == 400 + len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 400]
    assert len(held) > 50 and np.mean([r.predicted == int(r.doc_id % 5 > 0) for r in held]) > 0.95


def test_a_document_scores_what_all_labellings_say(spark):
    """The whole way of short documents, with the field that the query fits: every labelling of the lines on its own."""
    docs, labels = corpus(spark)
    field = line_quality.learn(docs, labels, "text", "doc_id", "quality", 3, 1, line_quality.SAMPLE)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in line_quality.score(docs, labels).collect()}
    checked = 0
    for i, text in texts.items():
        made, sizes, lines = line_quality.line_features(pa.array([(text or "").encode()], pa.binary()))
        n = int(lines[0])
        if n > 8 or i % 7:
            continue
        scaled = np.vstack([np.zeros(made.shape[1]), (made - field.mean) / field.spread, np.zeros(made.shape[1])])
        good = [float(np.concatenate([scaled[k + 1], scaled[k], scaled[k + 2], [1.0]]) @ field.weights) for k in range(n)]
        total, ones = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(np.clip(good[k], -30, 30) for k in range(n) if y[k]) + sum(field.moves[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            ones += w * np.array(y)
        mean = np.clip(((ones / total) * (sizes + 1)).sum() / (sizes + 1).sum(), 1e-6, 1 - 1e-6)
        want = 1 / (1 + np.exp(-(field.scale * np.log(mean / (1 - mean)) + field.shift)))
        assert got[i] == pytest.approx(want, abs=1e-5)
        checked += 1
    assert checked > 40


def test_the_sample_is_bounded_by_lines(spark, monkeypatch):
    docs, labels = corpus(spark)
    seen = []
    monkeypatch.setattr(line_quality, "SAMPLE_LINES", 100)
    monkeypatch.setattr(line_quality, "fit", lambda made, sizes, lines, labels: seen.append((len(made), lines.sum())) or 0.5)
    assert {r.score for r in line_quality.score(docs, labels).collect()} == {0.5}
    assert seen[0][0] == seen[0][1] and 80 <= seen[0][0] <= 100


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(spark)
    from tidemark.llm.hmm_lm import remainder

    fewer = labels.where(remainder(labels["doc_id"], 3) != 1)
    assert [r.score for r in line_quality.score(docs, fewer).orderBy("doc_id").collect()] == pytest.approx([r.score for r in line_quality.score(docs, labels).orderBy("doc_id").collect()], abs=1e-6)


def test_keep_good_carries_rows(spark):
    docs, labels = corpus(spark)
    kept = line_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in line_quality.score(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good


def test_edges(spark):
    docs, labels = corpus(spark)
    clashing = docs.selectExpr("*", "1 AS label", "2 AS raw", "3 AS quality", "4 AS score")
    assert [r.score for r in line_quality.score(clashing, labels).orderBy("doc_id").collect()] == [r.score for r in line_quality.score(docs, labels).orderBy("doc_id").collect()]
    assert line_quality.score(docs.where("false"), labels).count() == 0
    assert {r.score for r in line_quality.score(docs, labels.where("false")).collect()} == {0.5}
    assert {r.score for r in line_quality.score(docs, labels.where("quality = 1")).collect()} == {1.0}


@pytest.mark.parametrize("longest", [1, 2, 3, 7, 50])
def test_stretches_carry_what_is_around_them(longest):
    rng = np.random.default_rng(longest)
    lines = np.array([3, 1, 50, 7, 8, 6, 200])
    good, moves = rng.normal(0, 3, lines.sum()), rng.normal(0, 2, (2, 2))
    got, expected = crf.marginals(good, moves, lines, longest=longest)
    want, total = crf.marginals(good, moves, lines)
    assert got == pytest.approx(want, abs=1e-12) and expected == pytest.approx(total)


def test_neighbours_there_and_back():
    rng = np.random.default_rng(1)
    lines, parts = np.array([1, 4, 2, 9]), rng.normal(size=(16, 3))
    values = rng.normal(size=16)
    # the one is the transpose of the other
    assert values @ crf.with_neighbours(parts, lines) == pytest.approx((crf.to_neighbours(values, lines) * parts).sum(), rel=1e-5)


def test_long_texts_score_alike_in_slices(spark):
    docs, labels = corpus(spark)
    field = line_quality.learn(docs, labels, "text", "doc_id", "quality", 3, 1, line_quality.SAMPLE)
    rng = random.Random(3)
    text = "\n".join(rng.choice(["A line of words, as they come.", "W1!! W2!!", "", "x ### y", "É" * 30]) for _ in range(60_000)).encode()
    long = pa.array([text, b"short", text[:70], b"no newline " * 3000, b"\n" * 5000], pa.binary())
    whole = line_quality.scores_of(field, long, size=1 << 30)
    assert line_quality.scores_of(field, long, size=20_000) == pytest.approx(whole, abs=1e-6)
    assert b"".join(line_quality.slices(text, 1000)) == text
    assert [*line_quality.slices(b"", 10)] == [b""] and [*line_quality.slices(b"x" * 50, 10)] == [b"x" * 50]


def test_a_text_of_very_many_lines_is_scored_in_time(spark):
    import time

    docs, labels = corpus(spark)
    field = line_quality.learn(docs, labels, "text", "doc_id", "quality", 3, 1, line_quality.SAMPLE)
    began = time.time()
    line_quality.scores_of(field, pa.array([b"ab cd\n" * 1_000_000], pa.binary()))
    assert time.time() - began < 30


def test_a_labelled_id_that_many_rows_repeat_counts_once(spark):
    docs, labels = corpus(spark)
    again = docs.unionByName(documents(spark, ["W1!! W2!! ###"] * 500, [0] * 500))
    fields = [line_quality.learn(d, labels, "text", "doc_id", "quality", 3, 1, line_quality.SAMPLE) for d in (docs.where("doc_id <> 0"), again)]
    assert np.abs(fields[0].weights - fields[1].weights).max() < 0.5
