"""Whitening of embeddings with distributed block matrices.

Each vector's entries become whole numbers on a fixed grid. Counts and sums of these are exact, the rows are centred and
numbered, and Spark's BlockMatrix multiplies the transposed rows with the rows: the scatter matrix. It is as small as the
vectors are wide, so its eigenvectors are found on the driver; a second block multiplication projects the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import settle

#: Steps of the grid in 1, and the number that stands for 0.
STEPS, ZERO = 64, 1_000_000
COMPONENTS = 32
#: Rows and columns of a block, and rows that one task multiplies, about.
ROWS, COLS, TASK_ROWS = 1024, 1024, 50_000
#: Components whose share of the variance is no more than this have no direction: their eigenvalue counts as 0.
LEAST_SHARE = 1e-13


def on_grid(embeddings: DataFrame) -> DataFrame:
    """vec_id and x (array of long) of the rows whose vector is whole: not null, not empty, no null, NaN or infinite entry.

    Vectors of several lengths can't be of one space: those of the most frequent length stay (of equals, the greatest).
    """
    c = F.col("embedding").cast("array<double>")
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.select("vec_id", c.alias("c")).filter(F.coalesce(sound & (F.size("c") > 0), F.lit(False)))
    rows = settle(rows.select("vec_id", F.transform("c", lambda v: F.floor(v * STEPS).cast("long") + ZERO).alias("x")), "whiten-grid")
    width = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    return rows.filter(F.size("x") == (width["w"] if width else 0))


def sums(grid: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of every dimension."""
    each = grid.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (each[0]["n"], [int(r["s"]) for r in each]) if each else (0, [])


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `row`: 0, 1, 2 and so on, without a gap, through the sizes of the partitions that are read."""
    rows = settle(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "whiten-parts")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(parts), "part").withColumn("row", F.col("before") + F.col("at")).drop("part", "at", "before")  # a row for each partition


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """rows (row, v: array of double) as blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("row", array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(ROWS, COLS)


def product(a: BlockMatrix, b: BlockMatrix, tasks: int = 1) -> BlockMatrix:
    """a times b; the dimension that they share is dealt to so many tasks, whose products are summed.

    PySpark's own multiply() would put all blocks of the shared dimension into one task.
    """
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, tasks)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def scatter(a: BlockMatrix, n: int) -> np.ndarray:
    """The rows' transpose times the rows, as wide as a row."""
    return product(a.transpose(), a, 1 + n // TASK_ROWS).toLocalMatrix().toArray()


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every whole vector and component.

    embeddings: vec_id (any type), embedding, and others, which are ignored. A null vec_id and repeated rows count as
    rows. Components are numbered by falling variance; their sign is free but the same in all rows. A component without
    variance (fewer rows than dimensions, constant vectors) has whitened null and explained 0 and no part in the error;
    without any variance the error is 0. An empty table gives an empty result. deviation is exact; past 64 bits it is an
    error, never a wrong number.
    """
    spark = embeddings.sparkSession
    grid = on_grid(embeddings)
    n, total = sums(grid)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    s = F.array(*[F.lit(v) for v in total])
    far = F.zip_with("x", s, lambda x, t: x * F.lit(n).cast("long") - t)
    square = lambda d: d.cast("decimal(19,0)") * d.cast("decimal(19,0)")
    deviation = F.aggregate("far", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + square(d)).cast("decimal(38,0)")).cast("long")
    # n * x - S is exact, so its quotient by n keeps all digits of a double
    centred = F.transform("far", lambda d: d.cast("double") / n)
    rows = numbered(grid.withColumn("far", far).select("vec_id", deviation.alias("deviation"), centred.alias("v")))

    width = len(total)
    blocks = block_matrix(rows, n, width)
    variance = scatter(blocks, n) / n
    values, vectors = np.linalg.eigh(variance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(variance))
    has = values > LEAST_SHARE * trace
    turn = np.zeros_like(vectors)
    turn[:, has] = vectors[:, has] / np.sqrt(values[has])
    parts = [turn[k : k + COLS] for k in range(0, width, COLS)]
    whitening = spark.sparkContext.parallelize([((k, 0), DenseMatrix(len(m), len(values), m.ravel(order="F"))) for k, m in enumerate(parts)])
    projected = product(blocks, BlockMatrix(whitening, COLS, len(values), width, len(values)))
    off = scatter(projected, n) / n - np.diag(has.astype(float))
    error = float(np.abs(off).max())

    white = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    white = white.select(F.col("index").alias("row"), vector_to_array("vector").alias("y")).join(rows.select("row", "vec_id", "deviation"), "row")
    share = F.array(*[F.lit(float(v / trace) if h else 0.0) for v, h in zip(values, has)])
    each = white.select("vec_id", "deviation", F.posexplode("y").alias("i", "y"))
    known = F.get(share, F.col("i"))
    return each.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(known > 0, F.col("y")).alias("whitened"), known.alias("explained"), F.lit(error).alias("identity_error"),
    )
