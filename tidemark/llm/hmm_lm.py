"""LM scoring with a hidden Markov language model.

A text is its lower-cased words and one end token. States emit word classes, and a class gives its words by their
training counts. A word that makes up more than one part in OWN of all tokens is a class of its own; the others share
hashed classes, whose number grows with the square root of the vocabulary; the end has a class of its own:

    P(text) = sum over state paths of prod move * emit(class) * (c + 0.1) / Z(class),
    Z(class) = sum over its training words of (c + 0.1), plus, in a hashed class, 0.1 for all words that were never seen

so the model is a proper distribution over texts whatever the size of the vocabulary. Texts are split into words twice: to
count these, and to write every text once as classes, which training and scoring read. Training: stretches of some texts,
SEED_TOKENS tokens in all, only say where to begin: the states of a first model are clusters of them. All counts of the final
model come from all training texts, by Baum-Welch passes over whole texts. The counts of a pass are summed up per partition, and
those of the partitions by Spark. Scoring runs the scaled forward recursion over every whole text.

Word counts may be a table of any size. Words that make up more than one part in HEAD of all tokens, which are fewer
than HEAD, are broadcast; the words of the tail are joined with the table of counts, where no word can be hot. Words are
told apart by their bytes everywhere.

Defined cases: a null or empty text is the end token alone; rows that repeat a doc_id are scored one by one (and train
one by one); a null doc_id counts as the text '' for the held-out rule; with no training text every count is zero; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import hmm
from tidemark.llm.shared import cut, utf8
from tidemark.llm.words import Words, chunks

STATES, PASSES = 16, 3
#: Tokens of the stretches of texts that say where to begin, about, and of one stretch at most.
SEED_TOKENS, SEED_TEXT = 400_000, 2_000
HEAD, OWN = 1_000_000, 1 << 16
#: Hashed classes per square root of the number of words, and at least.
TAIL, LEAST_TAIL = 32, 1024
#: Words and their bytes that a counting task holds before it adds up those that are equal, and hands them on if they are
#: still more than half; and tokens that Baum-Welch takes at once, at least.
HELD, HELD_BYTES, TOKENS = 1_000_000, 1 << 26, 4_000_000
ADD = 0.1


def remainder(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, size = [], 0, 0
    for batch in batches:
        for piece in chunks(batch.column(0)):
            words = Words(piece)
            held.append(pa.table([words.kinds, np.bincount(words.codes, minlength=len(words.kinds))], ["token", "n"]))
            rows, size = rows + held[-1].num_rows, size + held[-1].nbytes
            if rows > HELD or size > HELD_BYTES:
                summed = pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])
                held, rows, size = [summed], summed.num_rows, summed.nbytes
                if 2 * rows > HELD or 2 * size > HELD_BYTES:
                    yield from summed.to_batches()
                    held, rows, size = [], 0, 0
    for table in held:
        yield from table.to_batches()


def word_counts(texts: DataFrame) -> DataFrame:
    """texts (raw binary) -> token (binary) and its count c."""
    return texts.select("raw").mapInArrow(_count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def tail_classes(kinds: int) -> int:
    """How many hashed classes there are for so many words: a power of two."""
    return 1 << math.ceil(math.log2(max(LEAST_TAIL, TAIL * math.sqrt(kinds))))


class Vocabulary:
    """The words of the head, the most frequent first, and the classes of all words."""

    def __init__(self, words: list[bytes], own: int, tail: int):
        self.own, self.tail, self.end = own, tail, own + tail
        self.places = {w: k for k, w in enumerate(words)}

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its place in the head, -1 where it isn't there, and its class."""
        find, mask = self.places.get, self.tail - 1
        places = np.fromiter((find(w, -1) for w in words), dtype=np.int64, count=len(words))
        hashed = (places < 0) | (places >= self.own)
        classes = places.astype(np.int32)
        classes[hashed] = [self.own + (xxhash.xxh64_intdigest(words[k], 42) & mask) for k in np.flatnonzero(hashed)]
        return places, classes


def with_ends(words: Words, classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words, after each text's the end's; and tokens per text."""
    text = np.repeat(np.arange(len(words.per_text)), words.per_text)
    out = np.full(len(text) + len(words.per_text), end, dtype=np.int32)
    out[np.arange(len(text)) + text] = classes[words.codes]
    return out, words.per_text + 1


def as_classes(rows: DataFrame, vocabulary, logs) -> DataFrame:
    """rows (id, held_out, raw) -> id, held_out, and of every text:

    row, its number; n_tokens, with the end; seq, its classes, little-endian, with the end's; known and logs, how many of
    its words are in the head, and the sum of their logs; spent, the sum of its classes' logs; tail, its words beyond the head.
    vocabulary and logs are broadcast: what Vocabulary takes, and logs of the head's words and of the classes.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words, (log_at, log_mass) = Vocabulary(*vocabulary.value), logs.value
        log_at = np.append(log_at, 0.0)  # a word beyond the head, whose place is -1
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            first = 0
            for piece in chunks(batch.column(2)):
                found = Words(piece)
                n = len(found.per_text)
                places, kinds = known_words.look_up(found.distinct)
                text, at = np.repeat(np.arange(n), found.per_text), places[found.codes]
                classes, lengths = with_ends(found, kinds, known_words.end)
                ends = np.append(0, np.cumsum(4 * lengths)).astype(np.int32)
                seq = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(classes.astype("<i4"))])
                spent = np.bincount(np.repeat(np.arange(n), lengths), log_mass[classes], minlength=n)
                rare, per_text = found.picked(at < 0)
                tail = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_text)), pa.int32()), rare)
                columns = [np.arange(number, number + n), lengths, np.bincount(text[at >= 0], minlength=n), np.bincount(text, log_at[at], minlength=n), spent]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), *map(pa.array, columns), seq, tail],
                    ["id", "held_out", "row", "n_tokens", "known", "logs", "spent", "seq", "tail"],
                )
                first, number = first + n, number + n

    made = "row long, n_tokens long, known long, logs double, spent double, seq binary, tail array<binary>"
    return rows.select("id", "held_out", "raw").mapInArrow(task, f"id {kind}, held_out boolean, {made}")


def with_paths(made: DataFrame, model) -> DataFrame:
    """What as_classes made, with paths, log10 of the chance of a text's classes under a broadcast model less `spent`, for spent, seq and tail."""
    kept = ["id", "held_out", "row", "n_tokens", "known", "logs"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chances = hmm.log10_likelihood(model.value, *_together(batch.column("seq").to_pylist()))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(chances - batch.column("spent").to_numpy())], [*kept, "paths"])

    kind = made.schema["id"].dataType.simpleString()
    return made.select(*kept, "spent", "seq").mapInArrow(task, f"id {kind}, held_out boolean, row long, n_tokens long, known long, logs double, paths double")


def _together(column: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of several texts, and where each begins."""
    lengths = np.array([len(x) // 4 for x in column], dtype=np.int64)
    return np.frombuffer(b"".join(column), dtype="<i4"), np.append(0, np.cumsum(lengths)[:-1]) if len(lengths) else lengths


def _pass(seqs: DataFrame, model: hmm.Model) -> hmm.Counts:
    """Baum-Welch counts of all texts under a model."""
    classes, states = model.emit.shape
    shared = seqs.sparkSession.sparkContext.broadcast(model)
    names = [f"s{k}" for k in range(states)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = hmm.Counts.zero(states, classes)
        for batch in batches:
            held, size = [], 0
            for seq in batch.column(0).to_pylist():
                held.append(seq)
                size += len(seq) // 4
                if size > TOKENS:
                    hmm.baum_welch(shared.value, *_together(held), counts)
                    held, size = [], 0
            hmm.baum_welch(shared.value, *_together(held), counts)
        rows = np.concatenate([counts.emit, counts.move, counts.start[None, :]])
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *[pa.array(rows[some, k].astype(np.float32)) for k in range(states)]], ["at", *names])

    # a task has one row per class, so nothing is gained by summing before the shuffle; four bytes a count travel, sums are doubles
    made = seqs.select("seq").mapInArrow(task, "at long, " + ", ".join(f"{s} float" for s in names))
    summed = made.repartition("at").groupBy("at").agg(*[F.sum(s).alias(s) for s in names]).toPandas()
    shared.unpersist()
    whole = np.zeros((classes + states + 1, states))
    whole[summed["at"].to_numpy()] = summed[names].to_numpy()
    return hmm.Counts(whole[-1], whole[classes:-1], whole[:classes])


def stretches(seqs: DataFrame, most_tokens: int = SEED_TOKENS, longest: int = SEED_TEXT) -> list[bytes]:
    """Classes of about most_tokens tokens: from each text that a hash of it draws, a stretch of at most `longest`, which begins where the hash says.

    Equal texts are one, and the draw doesn't depend on where texts lie. There is always one if there is a text.
    """
    size, h = (F.octet_length("seq") / 4).cast("long"), F.xxhash64("seq")
    begins = F.pmod(F.xxhash64("seq", F.lit("begins")), F.greatest(F.lit(1).cast("long"), size - longest + 1))
    cut_out = F.substring("seq", (4 * begins + 1).cast("int"), F.lit(4 * longest))
    texts, tokens = seqs.agg(F.count("*"), F.sum(F.least(size, F.lit(longest)))).first()
    if not texts:
        return []
    many = max(1, math.ceil(texts * most_tokens / tokens))
    part = min(1.0, 2 * many / texts + 64 / texts)  # twice as many, so that the limit is met, but not all
    every = seqs.select(h.alias("h"), cut_out.alias("stretch"))
    drawn = every.where(F.pmod("h", F.lit(1_000_003)) < F.lit(math.ceil(part * 1_000_003)))
    found = drawn.distinct().orderBy("h", "stretch").limit(many).collect() or every.orderBy("h", "stretch").limit(1).collect()
    return [bytes(r.stretch) for r in found]


def train(seqs: DataFrame, shares: np.ndarray, states: int = STATES, passes: int = PASSES, seed: int = 3) -> hmm.Model:
    """seqs (checkpointed seq) of all training texts -> the model. shares: of each class in them."""
    sample = stretches(seqs)
    if not sample:
        return hmm.Counts.zero(states, len(shares)).model(shares)
    classes, starts = _together(sample)
    model = hmm.seeded(classes, np.diff(np.append(starts, len(classes))), shares, states, seed)
    for _ in range(passes):
        model = _pass(seqs, model).model(shares)
    return model


def score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", parts: int = 10, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score per row; trained where the id's remainder is not 0."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), (remainder(F.col(id_col), parts) == 0).alias("held_out"), utf8(F.col(text_col)).alias("raw"))
    texts = rows.where(~F.col("held_out"))
    ends = texts.count()
    counts = cut(word_counts(texts))
    known = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count("*").alias("v")).first()
    total, distinct = known.c + ends, known.v + min(ends, 1)
    head = counts.where(F.col("c") * HEAD > total).toPandas().sort_values(["c", "token"], ascending=[False, True])
    words, often = head["token"].map(bytes).tolist(), head["c"].to_numpy()
    own, tail = int((often * OWN > total).sum()), tail_classes(known.v)
    hashed = counts.where(F.col("c") * OWN <= total).groupBy(F.xxhash64("token").bitwiseAND(tail - 1).alias("k"))
    by_class = hashed.agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
    mass = np.full(own + tail + 1, ADD)
    mass[:own] += often[:own]
    mass[own + by_class["k"].to_numpy(dtype=np.int64)] += by_class["c"].to_numpy() + ADD * by_class["v"].to_numpy()
    mass[-1] += ends
    shares = mass / mass.sum()
    log_mass = np.log10(mass)
    log_mass[-1] = 0.0
    floor = np.log10(total + ADD * (distinct + 1))
    end_term = float(np.log10(ends + ADD))
    made = cut(as_classes(rows, sc.broadcast((words, own, tail)), sc.broadcast((np.log10(often + ADD), log_mass))))
    model = train(made.where(~F.col("held_out")).select("seq"), shares, states, passes)
    scored = with_paths(made, sc.broadcast(model))
    words = made.select("row", F.explode("tail").alias("token"))
    rare = counts.where(F.col("c") * HEAD <= total).select("token", "c")
    tails = (
        words.join(rare, "token", "left")
        .groupBy("row")
        .agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("tail_logs"), F.count("c").alias("tail_known"))
    )
    logs = F.col("logs") + F.coalesce("tail_logs", F.lit(0.0))
    return scored.join(tails, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + F.lit(min(ends, 1))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs + F.lit(end_term) - F.col("n_tokens") * F.lit(float(floor))).alias("base_score"),
        (logs + F.col("paths")).alias("score"),
    )
