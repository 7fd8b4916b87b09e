"""Whitening of embeddings by Spark MLlib's block matrices.

Components become whole numbers, x = floor(64 c) + 1,000,000. The distinct x vectors are the fit list; their sums are exact.
Centred rows of the list are indexed from 0 and laid into a distributed BlockMatrix; its transpose times itself is the scatter,
a matrix as wide as the vectors are, of which eigh runs locally; the BlockMatrix times the whitening matrix projects the rows.
The covariance of what comes out is taken the same way and held against the identity.

The transposed product has a single block as its result. MLlib would bring all rows to that block's one task; the split of
the middle dimension, which its multiply takes, gives each group of row blocks a task of its own and adds up their products.
Rows are projected once per distinct vector and brought back to the rows that have it, of which a third may be equal.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; a shorter vector counts as
filled up with components of 0, and so does an empty one; components beyond 2 ** 46 are taken as that; components without
variance (eigenvalues below rounding) are left out, so one distinct vector, or none, gives no rows; deviation is null where
it exceeds a long; repeated ids are rows of their own; a null id takes part; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hot_join import join_hot
from tidemark.llm.shared import cut

SHIFT, STEPS = 1_000_000, 64
MOST = float(2**52)
#: Rows of a block, at least; blocks, at most; row blocks that a product takes in one task.
BLOCK, MOST_BLOCKS, TOGETHER = 1024, 32_768, 8


def whole(vec: F.Column, width: int) -> F.Column:
    """x of every component."""
    x = lambda c: (F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.lit(float(STEPS)) * c.cast("double")))) + SHIFT).cast("long")
    missing = F.array_repeat(F.lit(float(0)), F.lit(width) - F.size(vec))
    return F.transform(F.concat(vec.cast("array<double>"), missing), x)


def indexed(rows: DataFrame) -> DataFrame:
    """rows (checkpointed) with index: 0, 1, ... over all partitions."""
    at, inside = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    count = {r["p"]: r["n"] for r in rows.groupBy(at.alias("p")).agg(F.count("*").alias("n")).collect()}
    before = np.append(0, np.cumsum([count.get(p, 0) for p in range(max(count, default=-1) + 1)])).tolist()
    return rows.withColumn("index", F.element_at(F.lit(before), at + 1).cast("long") + inside)


def matrix(rows: DataFrame, n: int, width: int, block: int) -> BlockMatrix:
    """rows (index long, values array<double>) as blocks of so many rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("values").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(block, width)


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left x right, the middle dimension being dealt to so many groups."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def second_moments(blocks: BlockMatrix, n: int) -> np.ndarray:
    """The mean of the outer products of rows: as wide as the rows, whatever their number."""
    splits = max(1, blocks.numRowBlocks // TOGETHER)
    return np.array(product(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()) / n


def back(blocks: BlockMatrix) -> DataFrame:
    """index, values of all rows."""
    rows = callMLlibFunc("getIndexedRows", blocks.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("values"))


def deviations(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """index, x, copies with deviation: the sum over dimensions of (n x - S) ** 2, exactly."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = math.isqrt((2**63 - 1) // max(1, len(sums)))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 2**63 and int(np.abs(z := n * x - np.array(sums, dtype=np.int64)).max(initial=0)) <= most:
                made = (z * z).sum(axis=1).tolist()
            else:
                made = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d if d < 2**63 else None for d in made], pa.int64())], [*batch.schema.names, "deviation"])

    return fit.select("index", "copies", "x").mapInArrow(task, "index long, copies long, x array<long>, deviation long")


def whiten(embeddings: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """id_col, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error per row and component."""
    vec = F.col(vec_col)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = embeddings.where(vec.isNotNull() & ~F.exists(vec, odd)).select(F.col(id_col).alias("id"), vec.alias("vec"))
    width = sound.agg(F.max(F.size("vec"))).first()[0] or 0
    kind = embeddings.schema[id_col].dataType.simpleString()
    none = embeddings.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if not width:
        return none
    rows = sound.select("id", whole(F.col("vec"), width).alias("x"))
    fit = indexed(cut(rows.groupBy("x").agg(F.count("*").alias("copies"))))
    totals = fit.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]).first()
    n, sums = totals["n"], [int(totals[f"s{k}"]) for k in range(width)]
    size = max(block, math.ceil(n / MOST_BLOCKS))
    means = F.lit([s / n for s in sums])
    centred = fit.select("index", F.zip_with("x", means, lambda x, m: x.cast("double") - m).alias("values"))
    blocks = matrix(centred, n, width, size)
    values, vectors = np.linalg.eigh(second_moments(blocks, n))
    values, vectors = values[::-1], vectors[:, ::-1]
    used = min(components, int((values > values[0] * width * np.finfo(float).eps).sum())) if values[0] > 0 else 0
    if not used:
        return none
    turn = vectors[:, :used] / np.sqrt(values[:used])
    spark = embeddings.sparkSession
    whitening = matrix(spark.createDataFrame([(k, turn[k].tolist()) for k in range(width)], "index long, values array<double>"), width, used, width)
    white = cut(back(product(blocks, whitening, 1)))
    again = matrix(white, n, used, size)
    error = float(np.abs(second_moments(again, n) - np.eye(used)).max())
    named = cut(deviations(fit, n, sums).join(white, "index").select("x", "copies", "deviation", F.col("values").alias("white")))
    told = join_hot(rows, named, "x", "copies")
    share = F.lit((values[:used] / values.sum()).tolist())
    each = told.select("id", "deviation", F.posexplode(F.arrays_zip(F.col("white").alias("w"), share.alias("e"))).alias("at", "c"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("c")["w"].alias("whitened"), F.col("c")["e"].alias("explained"), F.lit(error).alias("identity_error")
    )
