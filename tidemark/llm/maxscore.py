"""Exact top-k by inner product with MaxScore.

Vectors become integer impacts. Rows are dealt to shards; a shard's rows are halved along the dimension of greatest
spread until they stand in blocks of BLOCK rows, and every block knows the least and greatest impact of each dimension
(so the bounds of each term's contributions there) and its longest vector. A shard answers its queries so:

* a block whose bound stays below a query's known k-th score is skipped as a whole;
* a query's terms are ordered by the span of their contributions; the non-essential ones are the longest run of smallest
  spans whose joint bound (the sum of the terms' bounds, or by Cauchy and Schwarz) stays below SHARE of the k-th score, so
  that no row can enter the result on them alone;
* the essential postings of a block are traversed for a tile of queries at once, by one matrix product whose weights are
  zero at the non-essential terms;
* the other terms are probed only for rows whose partial score plus the bound of the rest can still reach the k-th score.

The k-th score is known from the start: a first pass over a bounded sample of rows gives each query k real scores, and
every finished block raises it. Each row is sent once per block of queries (one, up to QUERIES) and each query once per
shard; a shard's index is built once, and its queries stream past it. The best of all shards are merged per query.

Rows of equal vectors are one posting with their k + 1 smallest ids, as no other id of them can enter a result.

Defined cases: a null vector, one with a null, NaN or infinite component, and a null id take no part; shorter vectors
count as padded with zeros; rows that repeat an id are candidates of their own, and query rows that repeat an id are
answered one by one; a query's own row is one row with its id and its vector; ties go to the smaller id; scores beyond
64 bits are an error; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut

#: Rows of a shard at most and at least (but for a small table), about, and queries that stream past one.
SHARD, LEAST, QUERIES = 65_536, 8_192, 1 << 21
#: Rows of a block, queries of a tile.
BLOCK, TILE = 512, 1024
#: Rows of the first pass.
SAMPLE = 4096
#: What part of the k-th score the non-essential terms may reach together.
SHARE = 0.5


def _float_type(width: int, a: int, b: int):
    """The type in which every inner product is exact."""
    most = max(width, 1) * max(a, 1) * max(b, 1)
    if most >= 2**63:
        raise ValueError("scores don't fit 64 bits")
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def _best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, by query, score and id."""
    order = np.lexsort((ids, -score, q))
    own = q[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[place < k]


class Shard:
    """Distinct vectors in blocks with their bounds; of each, its smallest ids."""

    def __init__(self, vectors: np.ndarray, ids: list, k: int, block: int = BLOCK):
        """ids: an array of ids per vector; vectors may repeat."""
        self.k = k
        vectors, which = np.unique(vectors, axis=0, return_inverse=True)
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
        owner = np.repeat(which.ravel(), [len(x) for x in ids])
        kept = _best(owner, np.zeros(len(flat), dtype=np.int64), flat, k)
        flat, owner = flat[kept], owner[kept]
        order, ends = self._blocks(vectors, block)
        self.vectors = np.ascontiguousarray(vectors[order])
        at = np.searchsorted(owner, np.arange(len(vectors) + 1))
        lengths = np.diff(at)[order]
        self.first = np.append(0, np.cumsum(lengths))
        self.ids = flat[np.repeat(at[:-1][order] - self.first[:-1], lengths) + np.arange(self.first[-1])]
        self.starts = np.append(0, ends)
        self.low = np.array([self.vectors[a:b].min(axis=0) for a, b in self.spans()])
        self.high = np.array([self.vectors[a:b].max(axis=0) for a, b in self.spans()])
        self.radius = np.array([math.sqrt(float((self.vectors[a:b].astype(np.float64) ** 2).sum(axis=1).max())) for a, b in self.spans()])
        #: Postings that searches have looked at, of how many a full product would.
        self.visited = self.total = 0

    def spans(self):
        return zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)

    @staticmethod
    def _blocks(vectors: np.ndarray, block: int) -> tuple[np.ndarray, list]:
        order, ends, stack = [], [], [np.arange(len(vectors))]
        while stack:
            rows = stack.pop()
            if len(rows) <= block:
                order.append(rows)
                ends.append((ends[-1] if ends else 0) + len(rows))
                continue
            values = vectors[rows]
            d = int(np.argmax(values.std(axis=0)))
            half = np.argpartition(values[:, d], len(rows) // 2)
            stack += [rows[half[len(rows) // 2 :]], rows[half[: len(rows) // 2]]]
        return np.concatenate(order), ends

    def search(self, queries: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query positions, ids, scores and whether a row equals its query: the k best of each that reach its floor, a
        score (or -inf) that k rows anywhere are known to reach."""
        found = [self._tile(queries[at : at + TILE], floors[at : at + TILE].astype(np.float64), at) for at in range(0, len(queries), TILE)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _tile(self, asked: np.ndarray, floors: np.ndarray, at: int):
        peak = lambda x: int(np.abs(x).max(initial=0))
        kind = _float_type(asked.shape[1], peak(asked), peak(self.vectors))
        wide = asked.astype(np.float64)
        up, down = np.maximum(wide, 0), np.minimum(wide, 0)
        low, high = self.low.astype(np.float64), self.high.astype(np.float64)
        norm = np.sqrt((wide**2).sum(axis=1))
        bound = np.minimum(up @ high.T + down @ low.T, norm[:, None] * self.radius + 1e-6)
        # terms by span over the shard; the longest run of smallest spans that stays below SHARE of the floor
        least, most = low.min(axis=0), high.max(axis=0)
        order = np.argsort(np.abs(wide) * (most - least), axis=1, kind="stable")
        sorted_ = np.take_along_axis(wide, order, axis=1)
        tops = np.cumsum(np.take_along_axis(up * most + down * least, order, axis=1), axis=1)
        reach = np.minimum(tops, np.sqrt(np.cumsum(sorted_**2, axis=1)) * self.radius.max() + 1e-6)
        # a prefix of bounds need not rise, so the run ends where it first reaches too far
        run = np.minimum.accumulate(reach <= SHARE * floors[:, None], axis=1) & (floors[:, None] > 0)
        idle = np.zeros(wide.shape, dtype=bool)
        np.put_along_axis(idle, order, run, axis=1)
        rest_wide = np.where(idle, wide, 0.0)
        beyond = np.minimum(np.maximum(rest_wide, 0) @ high.T + np.minimum(rest_wide, 0) @ low.T, np.sqrt((rest_wide**2).sum(axis=1))[:, None] * self.radius + 1e-6)
        essential, rest = np.where(idle, 0, asked).astype(kind), np.where(idle, asked, 0).astype(kind)
        n_idle = idle.sum(axis=1)
        held_q, held_row, held_score, held = [], [], [], 0

        def reduce():
            nonlocal held_q, held_row, held_score, held
            q, row, score = map(np.concatenate, (held_q, held_row, held_score))
            kept = _best(q, score, self.ids[self.first[row]], self.k)
            q, row, score = q[kept], row[kept], score[kept]
            full = np.bincount(q, minlength=len(floors)) >= self.k
            np.maximum(floors, np.where(full, _last(q, score, len(floors)), -np.inf), out=floors)
            held_q, held_row, held_score, held = [q], [row], [score], len(q)

        for b in np.argsort(-bound.mean(axis=0), kind="stable"):
            begin, end = self.starts[b], self.starts[b + 1]
            self.total += len(asked) * (end - begin) * asked.shape[1]
            live = np.flatnonzero(bound[:, b] >= floors)
            if not len(live):
                continue
            rows = self.vectors[begin:end].astype(kind)
            partial = essential[live] @ rows.T
            self.visited += int((asked.shape[1] - n_idle[live]).sum()) * (end - begin)
            i, j = np.nonzero(partial >= (floors[live] - beyond[live, b])[:, None])
            self.visited += int(n_idle[live[i]].sum())
            if not len(i):
                continue
            if 8 * len(i) > partial.size:  # so many that a product costs less than single probes
                score = (partial + rest[live] @ rows.T)[i, j]
            else:
                score = partial[i, j] + (rest[live[i]] * rows[j]).sum(axis=1)
            reaches = score >= floors[live[i]]
            held_q.append(live[i[reaches]])
            held_row.append(begin + j[reaches])
            held_score.append(score[reaches].astype(np.int64))
            held += int(reaches.sum())
            if held > 4 * self.k * len(floors):
                reduce()
        if not held:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none.astype(bool)
        reduce()
        q, row, score = held_q[0], held_row[0], held_score[0]
        lengths = (self.first[1:] - self.first[:-1])[row]
        offsets = np.append(0, np.cumsum(lengths))
        ids = self.ids[np.repeat(self.first[row] - offsets[:-1], lengths) + np.arange(offsets[-1])]
        same = (self.vectors[row] == asked[q]).all(axis=1)
        q, score, same = np.repeat(q, lengths), np.repeat(score, lengths), np.repeat(same, lengths)
        kept = _best(q, score, ids, self.k)
        return q[kept] + at, ids[kept], score[kept], same[kept]


def _last(q: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """The last score of each query (rows in the order of queries), -inf where there is none."""
    out = np.full(n, -np.inf)
    out[q] = score  # of several, the last one written stays
    return out


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _packed(df: DataFrame, id_col: str, vector_col: str, scale: float, width: int, kind: str, keep: int | None) -> DataFrame:
    """Rows as ids (array) and v (integers as bytes); keep: rows of equal vectors in a batch are one, with so many smallest ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            out = np.zeros((batch.num_rows, width), dtype=kind)
            out[np.arange(width) < lengths[:, None]] = np.floor(scale * flat)
            ids = batch.column(0).to_numpy()
            if keep:
                out, which = np.unique(out, axis=0, return_inverse=True)
                kept = _best(which.ravel(), np.zeros(len(ids), dtype=np.int64), ids, keep)
                counts = np.bincount(which.ravel()[kept], minlength=len(out))
                ids = ids[kept]
            else:
                counts = np.ones(len(out), dtype=np.int64)
            made = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([made, pa.array([x.tobytes() for x in out], pa.binary())], ["ids", "v"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(task, "ids array<long>, v binary")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard: int = SHARD,
    least: int = LEAST,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), id_col, score: for each query its k best rows of vectors, its own row left out."""

    spark, v = vectors.sparkSession, F.col(vector_col)
    sound = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))

    def extent(df: DataFrame) -> tuple[int, int, int]:
        peak = F.max(F.array_max(F.transform(v, lambda x: F.abs(F.floor(F.lit(scale) * x.cast("double"))))))
        found = df.where(sound).agg(F.count("*"), F.max(F.size(v)), peak).first()
        return found[0], found[1] or 0, found[2] or 0

    (n, width, high), (m, wide, peak) = extent(vectors), extent(queries)
    width = max(width, wide, 1)
    _float_type(width, high, peak)
    kind = next(t for t in ("<i2", "<i4", "<i8") if max(high, peak) < np.iinfo(t).max)
    wanted = k + 1  # the query's own row may be among them
    rows = cut(_packed(vectors.where(sound), id_col, vector_col, scale, width, kind, wanted))
    asked = _packed(queries.where(sound), id_col, vector_col, scale, width, kind, None)

    # the first pass: k + 1 real scores of every query
    part = min(1.0, SAMPLE / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64("ids"), F.lit(1_000_003)) <= F.lit(part * 1_000_003)).limit(2 * SAMPLE).select("v").collect()
    sample = np.frombuffer(b"".join(bytes(r.v) for r in drawn), dtype=kind).reshape(-1, width)
    shared = spark.sparkContext.broadcast(sample)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own, out = _matrix(batch.column("v"), width, kind), np.full(batch.num_rows, -np.inf)
            exact = _float_type(width, high, peak)
            if len(known) >= wanted:
                right = known.T.astype(exact)
                for at in range(0, len(own), TILE):
                    scores = own[at : at + TILE].astype(exact) @ right
                    out[at : at + TILE] = np.partition(scores, len(known) - wanted, axis=1)[:, len(known) - wanted]
            yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("v"), pa.array(out)], ["ids", "v", "floor"])

    seeded = asked.mapInArrow(floors, "ids array<long>, v binary, floor double")
    seeded = cut(seeded.withColumn("q", F.monotonically_increasing_id()))

    parallel = 2 * spark.sparkContext.defaultParallelism
    shards, blocks = max(1, math.ceil(n / shard), min(math.ceil(n / least), parallel)), max(1, math.ceil(m / QUERIES))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # checkpointed rows keep their numbers, however often a task runs
    number = F.monotonically_increasing_id()
    left = rows.select(F.pmod(F.xxhash64(number), F.lit(shards)).cast("int").alias("s"), "ids", "v", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("q"), F.lit(None).cast("double").alias("floor"))
    left = left.select("*", every(blocks).alias("b"))
    right = seeded.select(every(shards).alias("s"), "ids", "v", F.lit(1).alias("kind"), "q", "floor", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("b"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, index, held = None, None, []
        for batch in batches:
            s, b, side = (batch.column(c).to_numpy() for c in ("s", "b", "kind"))
            edges = np.flatnonzero((s[1:] != s[:-1]) | (b[1:] != b[:-1]) | (side[1:] != side[:-1])) + 1
            for begin, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if begin == end:
                    continue
                if cell != (s[begin], b[begin]):
                    cell, index, held = (s[begin], b[begin]), None, []
                part = batch.slice(begin, end - begin)
                if side[begin] == 0:
                    held.append(part)
                    continue
                if index is None:
                    if not held:
                        continue
                    ids = [x for p in held for x in np.split(p.column("ids").flatten().to_numpy(), np.cumsum(np.diff(p.column("ids").offsets.to_numpy()))[:-1])]
                    index, held = Shard(np.concatenate([_matrix(p.column("v"), width, kind) for p in held]), ids, wanted, block), []
                # queries of equal vectors are answered once, from the lowest floor of theirs
                whole, which = np.unique(_matrix(part.column("v"), width, kind), axis=0, return_inverse=True)
                which, lowest = which.ravel(), np.full(len(whole), np.inf)
                np.minimum.at(lowest, which, part.column("floor").to_numpy())
                q, ids, score, same = index.search(whole, lowest)
                starts = np.searchsorted(q, np.arange(len(whole) + 1))
                lengths = np.diff(starts)[which]
                offsets = np.append(0, np.cumsum(lengths))
                at = np.repeat(starts[which] - offsets[:-1], lengths) + np.arange(offsets[-1])
                numbers, own = np.repeat(part.column("q").to_numpy(), lengths), np.repeat(part.column("ids").flatten().to_numpy(), lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers), pa.array(own), pa.array(ids[at]), pa.array(score[at]), pa.array(same[at] & (ids[at] == own))], ["q", "query_id", "id", "score", "own"]
                )

    dealt = left.unionByName(right).repartition(shards * blocks, "s", "b").sortWithinPartitions("s", "b", "kind")
    near = dealt.mapInArrow(answer, "q long, query_id long, id long, score long, own boolean")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("id"), F.desc("own"))
    best = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)
    mine = F.min(F.when(F.col("own"), F.col("place"))).over(Window.partitionBy("q"))
    ranked = best.withColumn("mine", mine).where(~F.col("mine").eqNullSafe(F.col("place")))
    rank = (F.col("place") - F.when(F.col("place") > F.col("mine"), 1).otherwise(0)).cast("int")
    return ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
