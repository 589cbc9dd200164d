"""Whitening of embeddings with distributed block matrices.

Vectors become integers, so that sums are exact and centring is one rounding.  Centred rows get dense
indices and are dealt into the blocks of a BlockMatrix; its transpose times itself is the scatter matrix,
whose eigenvectors are found locally, for it is as large as the vectors are wide.  The block matrix times
the matrix of scaled eigenvectors projects the rows.

The fit list has each distinct vector once.  All rows are projected through a matrix of their own, by
their own indices, so that a vector that a third of all rows repeat is never a join's key.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import write_table

#: Rows of a block and columns at most; the driver plans a product by the keys of the blocks, MOST_BLOCKS of them, so blocks of more rows come with more data.
ROWS, COLS, MOST_BLOCKS = 1024, 1024, 1 << 17
#: Blocks that one task multiplies and adds up in a scatter matrix.
IN_TASK = 8
#: Vectors with a larger component can't be taken to whole numbers.
LARGEST = float(1 << 50)
_SHAPE = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x): ``floor(scale * c) + shift`` for each component; vectors that are null or have an unsound component go."""
    c = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    sound = F.col(vector_col).isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(c, lambda v: F.floor(v * scale).cast("long") + shift).alias("x"))


def indexed(rows: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """``rows`` with dense indices ``idx`` from 0, and how many there are.

    A row's partition and place are written with it, so a task that runs again can't number anew.
    """
    placed = rows.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    held = write_table(placed, tag)
    starts, start = [], 0
    for part, n in held.groupBy("part").agg(F.count(F.lit(1))).orderBy("part").collect():  # a row per partition
        starts.append((part, start))
        start += n
    first = rows.sparkSession.createDataFrame(starts, "part int, start long")
    return held.join(F.broadcast(first), "part").withColumn("idx", F.col("start") + F.col("place")).drop("part", "place", "start"), start


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """The distributed matrix of ``rows`` (idx, v), kept until it is let go; lost blocks are made again from the written rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("idx", array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(max(ROWS, -(-n // MOST_BLOCKS)), min(COLS, width)).persist(StorageLevel.MEMORY_AND_DISK)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The matrix' transpose times the matrix.  The middle dimension is split, so that many tasks share in what ends as one block."""
    turned, splits = matrix.transpose(), max(1, matrix.numRowBlocks // IN_TASK)
    made = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def let_go(matrix: BlockMatrix) -> None:
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)


def product(spark: SparkSession, matrix: BlockMatrix, right: np.ndarray, tag: str) -> DataFrame:
    """(idx, w): the rows of the matrix times the local matrix, written."""
    per = matrix.colsPerBlock
    parts = [((i // per, 0), Matrices.dense(len(p), p.shape[1], p.ravel(order="F"))) for i in range(0, len(right), per) for p in [right[i : i + per]]]
    other = BlockMatrix(spark.sparkContext.parallelize(parts, len(parts)), per, right.shape[1], *right.shape)
    rows = callMLlibFunc("getIndexedRows", matrix.multiply(other).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return write_table(rows.select(F.col("index").alias("idx"), vector_to_array("vector").alias("w")), tag)


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue; the largest entry of each vector is positive, and values that are rounding errors are 0."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    values = np.where(values > len(covariance) * np.finfo(float).eps * max(values[0], 0.0), values, 0.0)
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each row on the ``most`` first components of the distinct vectors.

    A null vector, or one with a null, NaN, infinite or huge (2^50) component, is dropped; shorter vectors
    count as filled up with zeros.  Rows that repeat a vector or an id each have rows of their own, null
    ids too.  A component without variance (fewer distinct vectors than components, constant vectors)
    explains 0 and has a null ``whitened``; ``identity_error`` is that of the others, 0 if there are none.
    A deviation that is no 64-bit integer is null.  An empty table gives no rows; other columns are left.
    """
    session = vectors.sparkSession
    kind = vectors.select(id_col).schema[0].dataType.simpleString()
    rows, total = indexed(whole_numbers(vectors, id_col, vector_col, scale, shift), "vectors")
    if not total:
        return session.createDataFrame([], f"`{id_col}` {kind}, {_SHAPE}")
    width, low, high = rows.agg(F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not width:
        return session.createDataFrame([], f"`{id_col}` {kind}, {_SHAPE}")
    low, high = min(low, shift), max(high, shift)
    rows = rows.withColumn("x", F.when(F.size("x") == width, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(shift).cast("long"), width - F.size("x")))))
    fit, n = indexed(rows.select("x").distinct(), "fit-list")

    long = n * max(-low, high, high - low) < 1 << 62
    number = "long" if long else "decimal(38,0)"
    sums = [0] * width
    for i, s in fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast(number))).collect():  # a row per dimension
        sums[i] = int(s)
    sum_of = F.array(*[F.lit(str(s)).cast(number) for s in sums])
    apart = F.transform("x", lambda x, i: (x.cast(number) * n - sum_of[i]).cast(number))
    exact = "long" if (n * (high - low)) ** 2 * width < 1 << 62 else "decimal(38,0)"
    deviation: Column = F.aggregate(apart, F.lit(0).cast(exact), lambda a, d: (a + d.cast(exact) * d.cast(exact)).cast(exact)).try_cast("long")
    centred = F.transform(apart, lambda d: d.cast("double") / F.lit(float(n)))

    def matrix(of: DataFrame, count: int) -> BlockMatrix:
        return block_matrix(of.select("idx", centred.alias("v")), count, width)

    listed = matrix(fit, n)
    covariance = scatter(listed) / n
    values, axes = components(covariance, most)
    lives = values > 0
    right = np.where(lives, axes / np.sqrt(np.where(lives, values, 1.0)), 0.0)
    own = product(session, listed, right, "whitened-fit")
    let_go(listed)
    mean = own.agg(*[F.avg(F.col("w")[i]) for i in range(len(values))]).first()
    again = block_matrix(own.select("idx", F.transform("w", lambda w, i: w - F.array(*map(F.lit, mean))[i]).alias("v")), n, len(values))
    away = np.abs(scatter(again) / n - np.eye(len(values)))[np.ix_(lives, lives)].max(initial=0.0)
    let_go(again)

    everyone = matrix(rows, total)
    done = product(session, everyone, right, "whitened")
    let_go(everyone)
    trace = float(np.trace(covariance))
    share = F.array(*[F.lit(float(v / trace) if trace > 0 else 0.0) for v in values])
    alive = F.array(*[F.lit(bool(x)) for x in lives])
    told = rows.select("idx", F.col("id").alias(id_col), deviation.alias("deviation")).join(done, "idx")
    out = told.select(id_col, "deviation", F.posexplode("w").alias("i", "w"))
    return out.select(
        id_col, (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(alive[F.col("i")], F.col("w")).alias("whitened"), share[F.col("i")].alias("explained"), F.lit(float(away)).alias("identity_error")
    )
