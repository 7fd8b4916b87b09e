"""Quality classifier: a linear-chain CRF over the lines of a document.

Every line gets features of its characters and words, taken from its bytes for a whole batch at once; the field labels
lines with their neighbours' features, and the marginals of forward-backward, weighted by the lines' lengths, make the
document's quality, calibrated to a probability.

The field is fitted on a bounded sample of labelled rows (SAMPLE, about so many documents of at most SAMPLE_BYTES bytes, one for each
id, taken in the order of a hash until they have SAMPLE_LINES lines); every document is scored over its whole text, a long one's
features slice by slice.

Defined cases: a null or empty text is one empty line; rows that repeat a doc_id are scored one by one; labels without
an id or quality are left out and the least quality counts where an id has several; without any usable label, or with one
kind only, every score is the share of label 1 (one half if there is none); a null doc_id counts as the text '' for the
held-out rule; an empty table gives an empty result; extra columns are ignored by `score` and carried through by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.crf import Field, fit
from tidemark.llm.hmm_lm import remainder
from tidemark.llm.shared import utf8
from tidemark.llm.words import LOWERED, Words, chunks

SAMPLE, SAMPLE_LINES = 6000, 1_000_000
#: A sampled document has no more bytes than this. Bytes of a long text whose features are held at once.
SAMPLE_BYTES, SLICE = 1 << 22, 1 << 21
NEWLINE = 10
# Bytes by kind: upper, lower, digit, space, sentence marks, shouts, symbols, bars, bytes above 127.
KINDS = 9
KIND = np.full(256, 6, dtype=np.int8)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[[9, 11, 12, 13, 32]] = 0, 1, 2, 3
KIND[[ord(c) for c in ".,;:'\"()-"]] = 4
KIND[[ord(c) for c in "!?"]] = 5
KIND[ord("|")] = 7
KIND[128:] = 8
KIND[NEWLINE] = -1


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a binary column of texts: features (lines, n), characters per line, lines per text (one at least)."""
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0]
    breaks = np.flatnonzero(raw == NEWLINE)
    # a line begins with each text and after each newline
    lines = 1 + np.diff(np.searchsorted(breaks, bounds))
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    # a newline at the end of a text makes its last line's start fall on the next text's: both stay, in order
    total = len(starts)
    line = np.searchsorted(starts, np.arange(len(raw)), "right") - 1
    count = np.zeros((total, KINDS))
    kind = KIND[raw]
    two_up = np.zeros(len(raw), dtype=bool)  # capitals of Latin-1: C3 80..9E
    two_up[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    kind = np.where(two_up, 0, kind)
    kind[:-1][two_up[1:]] = -1
    sizes = np.bincount(line, (raw & 0xC0) != 0x80, minlength=total)
    seen = kind >= 0
    count[:] = np.bincount(line[seen] * KINDS + kind[seen], minlength=total * KINDS).reshape(total, KINDS)
    words = Words(column)
    home = line[words.starts] if len(words.starts) else np.zeros(0, dtype=np.int64)
    n = np.bincount(home, minlength=total).astype(float)
    key = np.sort(home * np.int64(max(1, len(words.distinct))) + words.codes)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount(key[new] // max(1, len(words.distinct)), minlength=total)
    again = np.zeros(len(home), dtype=bool)
    again[1:] = (words.codes[1:] == words.codes[:-1]) & (home[1:] == home[:-1])
    length = words.ends - words.starts
    last = raw[words.ends - 1] if len(home) else np.zeros(0, dtype=np.uint8)
    odd = (KIND[last] >= 5) & (KIND[last] <= 7)
    per = lambda mask: np.bincount(home[mask], minlength=total)
    chars, w = np.maximum(sizes, 1.0), np.maximum(n, 1.0)
    letters = np.maximum(count[:, 0] + count[:, 1] + count[:, 8], 1.0)
    upper, symbols, shouts = count[:, 0] / letters, count[:, 6] / chars, count[:, 5] / w
    unlike = distinct / w
    made = np.column_stack([
        np.log1p(sizes), np.log1p(n), upper, upper > 0.5, upper > 0.2, count[:, 2] / chars, count[:, 4] / w, shouts, shouts > 0.3,
        symbols, symbols > 0.03, symbols > 0.1, count[:, 7] / w, count[:, 7] / w > 0.15, count[:, 8] / chars,
        unlike, unlike < 0.3, unlike < 0.6, np.log1p(n) * (1 - unlike), per(again) / w, per(again) / w > 0.1,
        np.bincount(home, length, minlength=total) / w / 10, per(length > 15) / w, per(length <= 3) / w, per(odd) / w, per(odd) / w > 0.3, sizes == 0,
    ])
    return made.astype(np.float64), sizes, lines


def learn(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, parts: int, left_out: int, sample: int) -> Field | float:
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(F.col(id_col), parts) != left_out))
    usable = usable.groupBy(F.col(id_col).alias("__label_id")).agg(F.min(label_col).cast("int").alias("label"))
    many = usable.count()
    part = min(1.0, sample / max(many, 1))
    drawn = usable.where(F.pmod(F.xxhash64("__label_id"), F.lit(1_000_003)) < F.lit(part * 1_000_003))
    texts = docs.select(F.col(id_col).alias("__doc_id"), utf8(F.col(text_col)).alias("raw")).where(F.octet_length("raw") <= SAMPLE_BYTES)
    met = texts.join(F.broadcast(drawn), F.col("__doc_id") == F.col("__label_id")).withColumn("place", F.xxhash64("__label_id", "raw"))
    rows = met.groupBy("__label_id").agg(F.min("label").alias("label"), F.min_by("raw", "place").alias("raw"), F.min("place").alias("place")).select("label", "raw", "place")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for piece in chunks(batch.column(1)):
                made, sizes, lines = line_features(piece)
                starts = np.append(0, np.cumsum(lines))
                out = [made[a:b].astype(np.float32).tobytes() for a, b in zip(starts, starts[1:], strict=False)]
                size = [sizes[a:b].astype(np.float32).tobytes() for a, b in zip(starts, starts[1:], strict=False)]
                own = [batch.column(k).slice(at, len(piece)) for k in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(out, pa.binary()), pa.array(size, pa.binary())], ["label", "place", "made", "sizes"])
                at += len(piece)

    most = SAMPLE_LINES

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = 0
        for batch in batches:
            ends = taken + np.cumsum([len(x) // 4 for x in batch.column(3).to_pylist()])
            rows = int((ends <= most).sum()) or int(taken == 0 and batch.num_rows > 0)  # one document at least
            if rows:
                yield batch.slice(0, rows)
            if rows < batch.num_rows:
                for _ in batches:  # read to the end, so that the worker can be used again
                    pass
                return
            taken = int(ends[-1]) if batch.num_rows else taken

    # a bounded sample: one task sorts it, where a sort by ranges would make the features twice
    schema = "label int, place long, made binary, sizes binary"
    found = rows.mapInArrow(task, schema).repartition(1).sortWithinPartitions("place").mapInArrow(bounded, schema).select("label", "made", "sizes").toArrow().combine_chunks()
    wanted = found.column("label").to_numpy().astype(float)
    if not len(wanted) or wanted.min() == wanted.max():
        return float(wanted.mean()) if len(wanted) else 0.5
    sizes = [np.frombuffer(x.as_buffer(), dtype=np.float32) for x in found.column("sizes")]
    lines = np.array([len(x) for x in sizes])
    made = np.empty((int(lines.sum()), found.column("made")[0].as_buffer().size // 4 // int(lines[0])), dtype=np.float32)
    at = 0
    for x, n in zip(found.column("made"), lines.tolist(), strict=True):
        made[at : at + n] = np.frombuffer(x.as_buffer(), dtype=np.float32).reshape(n, -1)
        at += n
    sizes = np.concatenate(sizes).astype(float)
    del found
    return fit(made, sizes, lines, wanted)


def slices(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces of about `size` bytes, cut behind newlines."""
    at = 0
    while len(raw) - at > size:
        end = raw.rfind(b"\n", at, at + size + 1)
        end = raw.find(b"\n", at + size) if end < 0 else end
        if end < 0:
            break
        yield raw[at : end + 1]
        at = end + 1
    yield raw[at:]


def scores_of(field: Field, column: pa.Array, size: int = SLICE) -> np.ndarray:
    """Scores of a binary column of texts. Of a long text's lines only three numbers each are held."""
    found = []
    for piece in chunks(column):
        if len(piece) > 1 or piece[0].as_buffer() is None or piece[0].as_buffer().size <= size:
            found.append(field.score(*line_features(piece)))
            continue
        parts, sizes = [], []
        for part in slices(piece[0].as_py(), size):
            features, own, _ = line_features(pa.array([part], pa.binary()))
            parts.append(field.parts(features))
            sizes.append(own)
        # the empty line behind a cut is the next piece's first one
        parts = [x[:-1] for x in parts[:-1]] + parts[-1:]
        sizes = [x[:-1] for x in sizes[:-1]] + sizes[-1:]
        whole = np.concatenate(parts)
        found.append(field.scored(whole, np.concatenate(sizes), np.array([len(whole)])))
    return np.concatenate(found) if found else np.zeros(0)


def score(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", parts: int = 3, left_out: int = 1, sample: int = SAMPLE, keep: bool = False) -> DataFrame:
    """id_col, held_out, score, predicted per row; with keep, the rows of docs that are predicted good, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, text_col, id_col, label_col, parts, left_out, sample))

    def scores(column: pa.Array) -> np.ndarray:
        field = shared.value
        return np.full(len(column), field) if isinstance(field, float) else scores_of(field, column)

    if keep:

        @F.pandas_udf("boolean")
        def good(raw: pd.Series) -> pd.Series:
            return pd.Series(scores(pa.array(raw, pa.binary())) >= 0.5)

        return docs.where(good(utf8(F.col(text_col))))

    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col(id_col).alias("id"), (remainder(F.col(id_col), parts) == left_out).alias("held_out"), utf8(F.col(text_col)).alias("raw"))
    return rows.mapInArrow(task, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    return score(docs, labels, keep=True, **options)
