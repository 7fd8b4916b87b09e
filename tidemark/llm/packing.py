"""Sum-of-squares online packing of tokenised documents into windows.

A document's whole windows are cut first, where it is tokenised. What remains of it is a piece: a narrow row of its
place, length and checksum, without ids. Pieces go online to the windows: the state is the level array, levels[h] being
the number of open windows filled up to h, and a piece goes to the level h for which the sum of squares of the level
array grows least (h = 0 opens a window, and a window that becomes full leaves the array), the fullest such level on a
tie.

A task places about PIECES pieces. The pieces of its windows that never filled are handed on to fewer tasks, which place
them in the same way, until one task has them all: it places them, once more the longest first, and then lays the pieces
of the windows that are still open end to end and cuts them at the window size, the last part at powers of two. So no
padding is left, and only some pieces of the last windows are cut; the checksums of these parts are made from the
documents again. Where placing fills few windows (when hardly any two pieces fit together), tasks close their own windows so.

Every level is checkpointed, so a sequence is the same however often a task runs. Memory: about PIECES narrow rows per
task, or one document.

Defined cases: a null or empty text is the single end id; runs of white space of any length have the library's ids; rows that repeat a doc_id are packed one by one; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut

WINDOW = 1024
#: Pieces of a task, about; and cut parts whose keys may be broadcast.
PIECES = 100_000
#: Characters that are tokenised in one call.
CALL_CHARS = 200_000
#: White space in a row that the fast way takes.
RUN = 10_000
BLANK = re.compile(r"\s{%d}" % (RUN + 1))


class Packer:
    """The level array and the open windows of one task. place() and close() give finished windows: lists of pieces."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.stacks: list[list] = [[] for _ in range(window)]

    def place(self, piece, length: int) -> list | None:
        """Put a piece of 1 to window - 1 tokens into a window; the window's (piece, length), if that fills it."""
        size, levels = self.window, self.levels
        # growth of the sum of squares if a window at level h gets the piece, for h = 0 .. size - length
        growth = 1 - 2 * levels[: size - length + 1]
        growth[levels[: size - length + 1] == 0] = np.iinfo(np.int64).max // 2
        growth[0] = 0
        growth[:-1] += 2 * levels[length:size] + 1
        at = size - length - int(np.argmin(growth[::-1]))
        pieces = self.stacks[at].pop() if at else []
        levels[at] -= 1 if at else 0
        pieces.append((piece, length))
        if at + length == size:
            return pieces
        levels[at + length] += 1
        self.stacks[at + length].append(pieces)
        return None

    def taken(self) -> list:
        """The pieces of all open windows, fullest first; none is open then."""
        out = [x for stack in reversed(self.stacks) for pieces in stack for x in pieces]
        self.levels[:] = 0
        self.stacks = [[] for _ in range(self.window)]
        return out


def laid(pieces: list, window: int) -> Iterator[list]:
    """Windows without padding from (piece, length), end to end: lists of (piece, tokens of it before, length)."""
    row, room, left = [], 0, sum(n for _, n in pieces)
    for piece, length in pieces:
        begin = 0
        while begin < length:
            if not row:
                room = min(window, 1 << (left.bit_length() - 1))
            part = min(room, length - begin)
            row.append((piece, begin, part))
            begin, room, left = begin + part, room - part, left - part
            if not room:
                yield row
                row = []


#: Fixed value: the public split pattern of byte-level BPE vocabularies with about 50,000 entries.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_vocabulary(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE file whose ids follow its merges, so that they can stand for the ranks; else None."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("byte_fallback"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    octet = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    added = {x["content"] for x in spec.get("added_tokens", ())}
    ranks = {bytes(octet[c] for c in word): k for word, k in model["vocab"].items() if word not in added}
    merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    order = [model["vocab"][m.replace(" ", "")] for m in merged]
    return ranks if order == sorted(order) and len(ranks) == 256 + len(order) else None


def encoder(tokenizer_path: str, end_id: int):
    """A function from texts to id arrays that end with end_id.

    The ids are those of the tokenizers library with this file and add_special_tokens=False. Where the file is a plain
    byte-level BPE, tiktoken makes the same ids from the file's own vocabulary at a fraction of the time; but its split
    pattern goes back over a run of white space step by step, and its stack ends after some 700,000: texts with a run of more
    than RUN go to the library itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = json.load(file)
    ranks = byte_vocabulary(spec)
    if ranks is None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        return lambda texts: [np.array([*e.ids, end_id], dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    import tiktoken

    special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    held: list = []  # the library itself, once a text needs it

    def encode(text: str) -> np.ndarray:
        if len(text) > RUN and BLANK.search(text):
            if not held:
                from tokenizers import Tokenizer

                held.append(Tokenizer.from_file(tokenizer_path))
            return np.array([*held[0].encode(text, add_special_tokens=False).ids, end_id], dtype="<u4")
        marked = any(s in text for s in special)
        ids = own.encode(text, allowed_special="all") if marked else own.encode_ordinary(text)
        ids.append(end_id)
        return np.array(ids, dtype="<u4")

    return lambda texts: [encode(t) for t in texts]


def calls(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    """Rows in groups of about CALL_CHARS characters."""
    a, b, chars = [], [], 0
    for i, text in zip(ids, texts, strict=True):
        a.append(i)
        b.append(text)
        chars += len(text) + 1
        if chars >= CALL_CHARS:
            yield a, b
            a, b, chars = [], [], 0
    if a:
        yield a, b


def _tokenised(rows: DataFrame, kind: str, tokenizer_path: str, end_id: int, window: int) -> DataFrame:
    """Per document: id, hash (of the text), total, seq (of its first whole window), crcs of whole windows, rest and its crc."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, end_id)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for at, texts in calls(list(range(batch.num_rows)), batch.column(2).to_pylist()):
                for tokens in encode(texts):
                    total = len(tokens)
                    crcs = [zlib.crc32(tokens[k : k + window].tobytes()) for k in range(0, total - window + 1, window)]
                    rest = total % window
                    out.append((total, number, crcs, rest, zlib.crc32(tokens[total - rest :].tobytes())))
                    number += len(crcs)
            if out:
                total, seq, crcs, rest, crc = zip(*out, strict=True)
                made = [pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "hash", "total", "seq", "crcs", "rest", "crc"])

    return rows.mapInArrow(task, f"id {kind}, hash long, total long, seq long, crcs array<long>, rest long, crc long")


PLACED = ["id", "hash", "start", "length", "crc", "total", "seq", "offset"]


def _placed(pieces: DataFrame, kind: str, window: int, level: int, last: bool) -> DataFrame:
    """pieces with seq and offset; both null for a piece of a window that is still open, crc null for a part that was cut."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(window), level << 58 | TaskContext.get().partitionId() << 33
        types, out = None, []

        def finish(parts) -> None:
            nonlocal number
            offset = 0
            for (key, hashed, start, whole, crc, total), begin, length in parts:
                out.append((key, hashed, start + begin, length, crc if length == whole else None, total, number, offset))
                offset += length
            number += 1

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], PLACED)
            out.clear()
            return made

        def place(piece, length: int) -> None:
            if full := packer.place(piece, length):
                finish((x, 0, n) for x, n in full)

        for batch in batches:
            types = [batch.column(0).type, *[pa.int64()] * 7]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place(row, row[3])
            if out:
                yield batch_of()
        if last:
            for piece, length in sorted(packer.taken(), key=lambda x: -x[1]):
                place(piece, length)
            for parts in laid(packer.taken(), window):
                finish(parts)
        else:
            out.extend((*piece, None, None) for piece, _ in packer.taken())
        if out:
            yield batch_of()

    return pieces.select(*PLACED[:6]).mapInArrow(task, f"id {kind}, hash long, start long, length long, crc long, total long, seq long, offset long")


def _summed(rows: DataFrame, parts: DataFrame, kind: str, tokenizer_path: str, end_id: int, few: bool) -> DataFrame:
    """Cut parts (distinct id, hash, start, length) with their crc, from the documents again."""
    small = F.broadcast if few else lambda df: df
    keys = parts.groupBy(F.col("id").alias("k_id"), F.col("hash").alias("k_hash")).agg(F.collect_set(F.struct("start", "length")).alias("parts"))
    own = (rows["hash"] == F.col("k_hash")) & rows["id"].eqNullSafe(F.col("k_id"))
    texts = rows.join(small(keys.select("k_id", "k_hash")), own, "left_semi").groupBy("id", "hash").agg(F.first("text").alias("text"))
    wanted = texts.join(small(keys), (texts["hash"] == F.col("k_hash")) & texts["id"].eqNullSafe(F.col("k_id"))).select("id", "hash", "text", "parts")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, end_id)
        for batch in batches:
            out = []
            for at, texts in calls(list(range(batch.num_rows)), batch.column(2).to_pylist()):
                for k, tokens in zip(at, encode(texts), strict=True):
                    out += [(k, p["start"], p["length"], zlib.crc32(tokens[p["start"] : p["start"] + p["length"]].tobytes())) for p in batch.column(3)[k].as_py()]
            if out:
                at, *made = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), *(pa.array(c, pa.int64()) for c in made)], ["id", "hash", "start", "length", "crc"])

    return wanted.mapInArrow(task, f"id {kind}, hash long, start long, length long, crc long")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    text_col: str = "text",
    id_col: str = "doc_id",
    end_id: int = 0,
    window: int = WINDOW,
    pieces: int = PIECES,
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    made = cut(_tokenised(rows, kind, tokenizer_path, end_id, window))
    whole = made.select("id", "hash", "total", "seq", F.posexplode("crcs").alias("at", "crc"))
    whole = whole.select("id", "hash", (F.col("at") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "crc", "total", F.col("seq") + F.col("at"), F.lit(0).cast("long"))
    result = whole.toDF(*PLACED)
    left = made.where("rest > 0").select("id", "hash", (F.col("total") - F.col("rest")).alias("start"), F.col("rest").alias("length"), "crc", "total")
    count, level, stuck = left.count(), 1, False
    while count:
        tasks = math.ceil(count / pieces)
        last = tasks == 1 or stuck
        placed = cut(_placed(left.repartition(tasks), kind, window, level, last))
        result = result.unionByName(placed.where("seq IS NOT NULL"))
        left = placed.where("seq IS NULL").select(*PLACED[:6])
        before, count, level = count, 0 if last else left.count(), level + 1
        stuck = 2 * count > before
    bare = result.where("crc IS NULL").select("id", "hash", "start", "length").distinct()
    if level > 1 and (parts := bare.count()):
        few = parts <= PIECES
        sums = _summed(rows, bare, kind, tokenizer_path, end_id, few).select(*[F.col(c).alias(f"s_{c}") for c in ("id", "hash", "start", "length", "crc")])
        same = (result["hash"] == F.col("s_hash")) & (result["start"] == F.col("s_start")) & (result["length"] == F.col("s_length")) & result["id"].eqNullSafe(F.col("s_id"))
        joined = result.where("crc IS NULL").join(F.broadcast(sums) if few else sums, same)
        result = result.where("crc IS NOT NULL").unionByName(joined.select(*[F.col("s_crc" if c == "crc" else c).alias(c) for c in PLACED]))
    return result.select(
        F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("total").alias("doc_tokens"), F.col("seq").alias("sequence_id"), "offset"
    )
