import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemark.llm import hmm, hmm_lm
from tidemark.llm.words import Words, chunks
from tests.llm.helpers import AWKWARD, documents, words


def test_words_match_split():
    texts = [(t or "").encode() for t in AWKWARD] + [b"A\x0bB\x0c c\r\nd", "  É ü".encode()]
    found = Words(pa.array(texts, pa.binary()).slice(1))
    want = [w for t in texts[1:] for w in t.lower().split()]
    assert found.tokens.to_pylist() == want and [found.distinct[k] for k in found.codes] == want
    assert found.per_text.tolist() == [len(t.split()) for t in texts[1:]]
    assert [len(c) for c in chunks(pa.array([], pa.binary()))] == []


def tiny(states=3, classes=5, seed=1):
    rng = np.random.default_rng(seed)
    move = rng.random((states, states))
    emit = rng.random((classes, states))
    return hmm.Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def by_paths(model, classes):
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(classes)):
        p = model.start[path[0]]
        for k, s in enumerate(path):
            p *= model.emit[classes[k], s] * (model.move[path[k - 1], s] if k else 1)
        total += p
    return math.log10(total)


def test_forward_sums_over_all_paths():
    model = tiny()
    lines = [[0, 1, 2, 3], [4], [2, 2], [1, 0, 4, 4, 3, 2]]
    got = hmm.log10_likelihood(model, np.concatenate(lines), np.array([0, 4, 5, 7]))
    assert got == pytest.approx([by_paths(model, x) for x in lines], rel=1e-5)


def test_long_texts_do_not_underflow():
    got = hmm.log10_likelihood(tiny(), np.zeros(30_000, dtype=np.int32), np.array([0]))
    assert np.isfinite(got[0]) and got[0] < -3000


def test_baum_welch_never_lowers_the_likelihood():
    rng = np.random.default_rng(3)
    classes, starts = rng.integers(0, 5, 400), np.arange(0, 400, 20)
    model, last = tiny(), -math.inf
    for _ in range(6):
        now = hmm.log10_likelihood(model, classes, starts).sum()
        assert now >= last - 1e-3
        counts, last = hmm.Counts.zero(3, 5), now
        hmm.baum_welch(model, classes, starts, counts)
        assert counts.emit.sum() == pytest.approx(400, rel=1e-5) and counts.move.sum() == pytest.approx(380, rel=1e-5)
        model = hmm.Model(counts.start / counts.start.sum(), counts.move / counts.move.sum(1, keepdims=True), counts.emit / counts.emit.sum(0))


def by_all_pairs(model, classes):
    """Expected counts by the unscaled recursions over a whole sequence."""
    n, states = len(classes), len(model.start)
    alpha, beta = np.zeros((n, states)), np.ones((n, states))
    alpha[0] = model.start * model.emit[classes[0]]
    for t in range(1, n):
        alpha[t] = (alpha[t - 1] @ model.move) * model.emit[classes[t]]
    for t in range(n - 2, -1, -1):
        beta[t] = model.move @ (model.emit[classes[t + 1]] * beta[t + 1])
    gamma = alpha * beta / alpha[-1].sum()
    counts = hmm.Counts.zero(states, len(model.emit))
    counts.start += gamma[0]
    for t in range(n):
        counts.emit[classes[t]] += gamma[t]
        if t + 1 < n:
            counts.move += alpha[t][:, None] * model.move * (model.emit[classes[t + 1]] * beta[t + 1])[None, :] / alpha[-1].sum()
    return counts


@pytest.mark.parametrize(("stretch", "flush"), [(64, 500_000), (7, 30), (1, 1), (1000, 50)])
def test_baum_welch_carries_over_the_borders_of_stretches(monkeypatch, stretch, flush):
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    monkeypatch.setattr(hmm, "FLUSH", flush)
    rng = np.random.default_rng(4)
    lines = [rng.integers(0, 5, n) for n in (150, 1, 64, 65, 33, 128, 2, 150)]
    model, want, got = tiny(), hmm.Counts.zero(3, 5), hmm.Counts.zero(3, 5)
    for line in lines:
        own = by_all_pairs(model, line)
        want = hmm.Counts(want.start + own.start, want.move + own.move, want.emit + own.emit)
    hmm.baum_welch(model, np.concatenate(lines), np.append(0, np.cumsum([len(x) for x in lines])[:-1]), got)
    for a, b in ((got.start, want.start), (got.move, want.move), (got.emit, want.emit)):
        assert a == pytest.approx(b, rel=1e-4)


def test_classes_grow_with_the_words():
    assert [hmm_lm.tail_classes(v) for v in (0, 1000, 10**6, 10**8)] == [1024, 1024, 32_768, 524_288]
    found = hmm_lm.Vocabulary([b"the", b"of", b"rare"], 2, 1024)
    places, classes = found.look_up([b"of", b"new", b"rare", b"the"])
    assert places.tolist() == [1, -1, 2, 0] and classes[[0, 3]].tolist() == [1, 0] and (classes[1:3] >= 2).all() and (classes < found.end).all()


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_are_told_apart_by_their_bytes(spark):
    """Words that polynomial hashes modulo a power of two take for one another."""
    texts = []
    for n in (1024, 2048, 4096):
        one = thue_morse(n)
        texts += [one] * 11 + [one.translate(str.maketrans("ab", "ba"))]
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0]
    train = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 != 0]
    ids = [(held if k % 12 == 11 else train)[k] for k in range(len(texts))]
    got = {r.doc_id: r for r in hmm_lm.score(documents(spark, texts, ids), states=2).collect()}
    assert [got[ids[k]].n_known for k in (0, 12, 24)] == [2, 2, 2] and [got[ids[k]].n_known for k in (11, 23, 35)] == [1, 1, 1]


def two_tongues(n=300):
    rng = random.Random(1)
    tongues = [[f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)]]
    return [" ".join(rng.choice(tongues[k % 2]) for _ in range(rng.randrange(5, 60))) for k in range(n)]


@pytest.mark.parametrize(("head", "own"), [(10**6, 1 << 16), (5, 1), (10**6, 1), (100, 60)])
def test_scores(spark, monkeypatch, head, own):
    monkeypatch.setattr(hmm_lm, "HEAD", head)
    monkeypatch.setattr(hmm_lm, "OWN", own)
    texts = AWKWARD + two_tongues()
    got = {r.doc_id: r for r in hmm_lm.score(documents(spark, texts), states=4).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    counts = Counter(w for i, t in enumerate(texts) if not held[i] for w in words(t))
    ends = sum(not h for h in held.values())
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    for i, t in enumerate(texts):
        c = [counts[w] for w in words(t)] + [ends]
        want = sum(math.log10((n + 0.1) / (total + 0.1 * (kinds + 1))) for n in c)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(c), sum(n > 0 for n in c), total)
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert r.score < 0
    fresh = [got[i] for i in range(len(AWKWARD), len(texts)) if held[i]]
    assert sum(r.score for r in fresh) > sum(r.base_score for r in fresh)


def test_the_model_is_a_distribution(spark):
    """Over one-word texts: all known words and each class' unseen ones add up to the chance of one word and the end."""
    texts = two_tongues(60)
    docs = documents(spark, texts + sorted({w for t in texts for w in t.split()}))
    rows = hmm_lm.score(docs, states=2).collect()
    single = {docs_row: 10**r.score for docs_row, r in enumerate(sorted(rows, key=lambda r: r.doc_id)) if r.n_tokens == 2}
    assert 0 < sum(single.values()) < 1


def test_edges(spark):
    assert hmm_lm.score(documents(spark, ["a"]).where("false")).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = hmm_lm.score(documents(spark, ["a b", "a b"], [held, held])).collect()
    assert len(r) == 2 and r[0].n_known == 0 and r[0].train_tokens == 0 and r[0].score <= 0
    assert hmm_lm.score(documents(spark, ["a b"], [None])).first().held_out is True


@pytest.mark.parametrize("size", [300, 2500])
def test_texts_of_any_length_train(spark, size):
    """Halves of texts use different words: a state for each half explains them better than one distribution."""
    rng = np.random.default_rng(size)
    texts = [" ".join(f"{side}{w}" for side in "ab" for w in rng.integers(0, 50, size // 2)) for _ in range(60)]
    rows = hmm_lm.score(documents(spark, texts)).toPandas()
    assert (rows["score"] / rows["n_tokens"] - rows["base_score"] / rows["n_tokens"]).min() > 0.2


def test_the_sample_follows_the_texts_only(spark):
    texts = [np.arange(k, k + 3000, dtype="<i4").tobytes() for k in range(40)] + [b"\x01\0\0\0"] * 300
    table = spark.createDataFrame([(t,) for t in texts], "seq binary")
    made = [hmm_lm.stretches(table.repartition(n), 20_000, 500) for n in (1, 3, 7)]
    assert made[0] == made[1] == made[2] and len(made[0]) == len(set(made[0]))
    assert all(len(s) <= 2000 for s in made[0])
    copies = spark.createDataFrame([(texts[-1],)] * 100, "seq binary")
    assert hmm_lm.stretches(copies, 1, 500) == [texts[-1]]
    assert hmm_lm.stretches(table.where("false")) == []


def test_texts_are_split_into_words_twice_only(spark):
    """To count words of the training texts, and to write all texts as classes; scoring reads these."""
    texts, read = two_tongues(100), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = hmm_lm.score(documents(spark, texts).withColumn("text", seen("text")), states=2).collect()
    assert len(rows) == 100 and read.value == 100 + sum(not r.held_out for r in rows)


@pytest.mark.parametrize(("stretch", "flush"), [(7, 500_000), (1, 500_000), (1 << 16, 200)])
def test_sequences_go_together_over_the_borders_of_stretches(monkeypatch, stretch, flush):
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    monkeypatch.setattr(hmm, "FLUSH", flush)
    rng = np.random.default_rng(5)
    lines = [rng.integers(0, 5, n) for n in (150, 1, 64, 65, 7, 14, 33, 128, 2, 150)]
    starts, model, want, got = np.append(0, np.cumsum([len(x) for x in lines])[:-1]), tiny(), hmm.Counts.zero(3, 5), hmm.Counts.zero(3, 5)
    for line in lines:
        own = by_all_pairs(model, line)
        want = hmm.Counts(want.start + own.start, want.move + own.move, want.emit + own.emit)
    hmm.baum_welch(model, np.concatenate(lines), starts, got)
    for a, b in ((got.start, want.start), (got.move, want.move), (got.emit, want.emit)):
        assert a == pytest.approx(b, rel=1e-4)
    alone = [hmm.log10_likelihood(model, x, np.array([0]))[0] for x in lines]
    assert hmm.log10_likelihood(model, np.concatenate(lines), starts) == pytest.approx(alone, rel=1e-5)


def test_forward_variables_of_what_fits_are_computed_once(monkeypatch):
    steps, call = [], hmm._Forward.__call__
    monkeypatch.setattr(hmm._Forward, "__call__", lambda self, first, end, before: steps.append(end - first) or call(self, first, end, before))
    hmm.baum_welch(tiny(), np.zeros(2130, dtype=np.int32), np.array([0, 1000, 2000]), hmm.Counts.zero(3, 5))
    assert steps == [1000]


def test_state_weights_of_a_long_text_add_up():
    counts = hmm.Counts.zero(3, 5)
    hmm.baum_welch(tiny(), np.random.default_rng(6).integers(0, 5, 600_000), np.array([0]), counts)
    assert counts.emit.sum() == pytest.approx(600_000, rel=1e-6) and counts.move.sum() == pytest.approx(599_999, rel=1e-6)


def test_counting_hands_words_on(monkeypatch):
    batches = [pa.RecordBatch.from_arrays([pa.array([b"a B b c" * 2, b"", f"w{k} a".encode()], pa.binary())], ["raw"]) for k in range(50)]
    for held, size in ((10**6, 1 << 26), (12, 1 << 26), (1, 1 << 26), (10**6, 40)):
        monkeypatch.setattr(hmm_lm, "HELD", held)
        monkeypatch.setattr(hmm_lm, "HELD_BYTES", size)
        got = Counter()
        for made in hmm_lm._count(iter(batches)):
            for word, n in zip(made.column(0).to_pylist(), made.column(1).to_pylist(), strict=True):
                got[word] += n
        assert got == {b"a": 100, b"b": 200, b"c": 50, b"ca": 50} | {f"w{k}".encode(): 1 for k in range(50)}
    assert list(hmm_lm._count(iter([]))) == []
