"""Near-duplicate embeddings by dual traversal of cover trees: exactly the pairs at or above a cosine.

Equal vectors are one from the start, with the number of their copies. The upper levels of the cover tree are those of a
bounded sample: nested centres, radii halving until there are enough of them. Every vector belongs to the cell of its nearest
centre, whose cover is measured over all members. Two vectors within the radius of a link are in one cell, or each of them
lies within reach of the other's cell: by the cell's cover, and by the plane half-way between the two centres, neither of which
such a pair can be further across than the radius. So a vector visits the cells in reach only, and of each two cells one visits
the other. A cell of more than BLOCK vectors is dealt on to blocks by a hash, which visit each other the same way.

A block has a tree of its own, and visitors stream past it in trees of their own. Node pairs out of reach are pruned, node
pairs all within reach are counted and linked without listing them; a block emits one row per vector: its number of links
there and a vector that it is joined with. No pairs come out, and no two rows meet but by cell and block.

What this costs follows the data: on clusters, blocks meet their neighbours only; vectors without any structure are in
reach of nearly all cells, and then every pair of blocks is a matrix product. Near copies of one vector, of which a third of
all rows may be, are distinct vectors: their cell's blocks all visit each other, which is rows x rows / (2 x BLOCK) visits.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their
own component; a shorter vector counts as filled up with zeros; rows that repeat a vec_id are rows of their own, which link if
their vectors do; a null vec_id takes part, comes after all others, and is kept only where it is alone in its component;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.cover_tree import SLACK, Groups, Links, Tree, apart, levels, unit
from tidemark.llm.hot_join import join_hot
from tidemark.llm.shared import cut

#: Vectors of a block, about; cells, at most; sampled vectors for each cell.
BLOCK, MOST_CELLS, SAMPLE = 4096, 1024, 8


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of one width, filled up with zeros."""
    size = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def sound(vec: F.Column) -> F.Column:
    """Whether a vector has a direction."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vec.isNotNull() & ~F.exists(vec, odd) & F.exists(vec, lambda x: x != 0), F.lit(False))


def placed(distinct: DataFrame, centres: np.ndarray, width: int) -> DataFrame:
    """uid, copies, point (doubles of length one), cell, away (distance to its centre)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = unit(matrix(batch.column(2), width))
                cosine = points @ centres.T
                cell = cosine.argmax(axis=1)
                away = apart(cosine[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.tobytes() for p in points], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(away)], ["uid", "copies", "point", "cell", "away"])

    return distinct.select("uid", "copies", "vec").mapInArrow(task, "uid long, copies long, point binary, cell int, away double")


def visits(own, other):
    """Of two different numbers one visits the other, and about as many visit each as it visits; of numbers or arrays."""
    return (own != other) & ((own < other) == ((own + other) % 2 == 0))


def dealt(points: DataFrame, centres: np.ndarray, cover: np.ndarray, blocks: np.ndarray, radius: float) -> DataFrame:
    """cell, block, kind (0: at home, 1: visiting), uid, copies, point."""
    between = apart(centres @ centres.T)
    toward = visits(*np.indices((len(centres), len(centres))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = batch.column(3).to_numpy()
            vectors = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.float64).reshape(n, -1)
            cosine = vectors @ centres.T
            mixed = (batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            home = (mixed % blocks[own].astype(np.uint64)).astype(np.int64)
            reach = toward[own] & (apart(cosine) <= cover + radius + SLACK)
            reach &= cosine[np.arange(n), own][:, None] - cosine <= radius * between[own] + SLACK
            found = [(np.arange(n), own, home, 0)]
            for j in np.flatnonzero(reach.any(axis=0)):
                at = np.flatnonzero(reach[:, j])
                found += [(at, np.full(len(at), j), np.full(len(at), b), 1) for b in range(blocks[j])]
            for i in np.unique(own[blocks[own] > 1]):
                for b in range(blocks[i]):
                    at = np.flatnonzero((own == i) & visits(home, b))
                    found.append((at, np.full(len(at), i), np.full(len(at), b), 1))
            for at, cell, block, kind in found:
                if len(at):
                    rows = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell, pa.int32()), pa.array(block, pa.int32()), pa.array(np.full(len(at), kind), pa.int32()), rows.column(0), rows.column(1), rows.column(2)], ["cell", "block", "kind", "uid", "copies", "point"]
                    )

    return points.mapInArrow(task, "cell int, block int, kind int, uid long, copies long, point binary")


class Block:
    """The vectors at home in a block, past which visitors come."""

    def __init__(self, uid: np.ndarray, copies: np.ndarray, points: np.ndarray, cosine: float):
        self.tree, self.cosine = Tree(points, copies), cosine
        self.uid, self.groups = uid[self.tree.order], Groups(len(uid))
        self.count = Links(self.tree, self.tree, cosine, self.groups, 0).count_a

    def visited(self, uid: np.ndarray, copies: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """uid, one that it is joined with, and number of links of the visitors that have some."""
        other, home = Tree(points, copies), len(self.uid)
        self.groups.grown(len(uid))
        links = Links(self.tree, other, self.cosine, self.groups, home)
        self.count += links.count_a
        label, uid = self.groups.label[home:], uid[other.order]
        self.groups.label = self.groups.label[:home]
        some = links.count_b > 0  # joined with one at home, whose number is the smaller
        return uid[some], self.uid[label[some]], links.count_b[some]

    def ended(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = self.count > 0
        return self.uid[some], self.uid[self.groups.label[some]], self.count[some]


def linked(cells: DataFrame, cosine: float) -> DataFrame:
    """cells of `dealt` -> uid, near (one that it is joined with, maybe itself), links (rows, but copies of its own): of every block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, held = None, None, []
        out = lambda found: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["uid", "near", "links"])
        arrays = lambda t: (t.column("uid").to_numpy(), t.column("copies").to_numpy(), np.frombuffer(b"".join(t.column("point").to_pylist()), dtype=np.float64).reshape(t.num_rows, -1))

        def settled() -> Block | None:
            return Block(*arrays(pa.Table.from_batches(held)), cosine) if held else None

        for batch in batches:
            cell, number, kind = (batch.column(c).to_numpy() for c in ("cell", "block", "kind"))
            edges = np.flatnonzero((cell[1:] != cell[:-1]) | (number[1:] != number[:-1]) | (kind[1:] != kind[:-1])) + 1
            for begin, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if begin == end:
                    continue
                if at != (cell[begin], number[begin]):
                    block = block or settled()
                    if block:
                        yield out(block.ended())
                    at, block, held = (cell[begin], number[begin]), None, []
                part = batch.slice(begin, end - begin)
                if kind[begin] == 0:
                    held.append(part)
                    continue
                block = block or settled()
                if block:  # else nobody is at home
                    yield out(block.visited(*arrays(part)))
        block = block or settled()
        if block:
            yield out(block.ended())

    return cells.repartition("cell", "block").sortWithinPartitions("cell", "block", "kind").mapInArrow(task, "uid long, near long, links long")


def near_vectors(embeddings: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, most_cells: int = MOST_CELLS) -> DataFrame:
    """id_col, n_links (other rows at or above the cosine), component_id (smallest id reachable, itself included), kept."""
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))
    found = rows.where(sound(F.col("vec"))).groupBy("vec").agg(F.count("*").alias("copies"), F.min(place).alias("least"))
    distinct = cut(found.withColumn("uid", F.monotonically_increasing_id()))
    width, many = distinct.agg(F.max(F.size("vec")), F.count("*")).first()
    lone = [F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")]
    if not many:
        return rows.select(F.col("id").alias(id_col), *lone)
    wanted = max(1, min(most_cells, math.ceil(many / block)))
    sample = distinct.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE * wanted).toArrow()
    drawn = unit(matrix(sample.column("vec").combine_chunks(), width))
    centres = drawn[levels(drawn, wanted)]
    points = cut(placed(distinct, centres, width))
    cover, size = np.zeros(len(centres)), np.ones(len(centres), dtype=np.int64)
    for r in points.groupBy("cell").agg(F.max("away").alias("away"), F.count("*").alias("n")).collect():
        cover[r["cell"]], size[r["cell"]] = r["away"], r["n"]
    blocks = -(-size // block)
    links = cut(linked(dealt(points, centres, cover, blocks, math.sqrt(2 - 2 * cosine)), cosine))
    roots = components(links.select(F.col("uid").alias("a"), F.col("near").alias("b")))
    counts = links.groupBy("uid").agg(F.sum("links").alias("links"))
    known = distinct.join(counts, "uid", "left").join(roots, F.col("uid") == F.col("node"), "left")
    known = cut(known.select("vec", "copies", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "uid").alias("root")))
    smallest = cut(known.groupBy("root").agg(F.min("least").alias("first"), F.sum("copies").alias("rows"), F.count("*").alias("times")))
    named = cut(join_hot(known, smallest, "root", "times").select("vec", "copies", "n_links", "first", "rows"))
    told = join_hot(rows.where(sound(F.col("vec"))), named, "vec", "copies")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("id").isNotNull() | (F.col("rows") == 1))
    others = rows.where(~sound(F.col("vec")))
    return told.select(F.col("id").alias(id_col), "n_links", F.col("first.id").alias("component_id"), kept.alias("kept")).unionByName(others.select(F.col("id").alias(id_col), *lone))
