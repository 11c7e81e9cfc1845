"""Whitening of vectors: rows of whole numbers turned and scaled so that their components are uncorrelated and of variance 1.

The fit list, each distinct vector once, is centred and indexed into an MLlib BlockMatrix B;
B's transpose times B is the scatter matrix, whose eigenvectors over the roots of their
eigenvalues are the whitening matrix W. W is made from a matrix of dims by dims on the driver, of at
most DIMS by DIMS; B times W, in blocks again, projects the rows. The transpose of that product times
itself tells how far its covariance is from the identity. Rows stay in the JVM: vectors go
from columns to blocks and back without Python workers.
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

from dexspark.llm.common import materialise

#: Components become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned, rows and columns of a block, blocks that one task multiplies and adds up.
COMPONENTS, BLOCK, SHARE = 16, 1024, 8
#: Dimensions that the driver decomposes at most: a matrix of 128 MB.
DIMS = 4096
#: Largest component, so that a whole number times the size of the fit list stays a long.
MOST = 2.0**30
#: An eigenvalue below this share of the greatest is 0 but for rounding.
LEAST = 1e-10


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): vectors of whole numbers, without those that are null or hold null or non-finite components."""
    entries = F.col("embedding").cast("array<double>")
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("c")).filter("c is not null")
    own = own.filter(~F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    far = F.raise_error(F.lit(f"components above {MOST:.0f} are too large")).cast("long")
    return own.select("vec_id", F.transform("c", lambda c: F.when(F.abs(c) > MOST, far).otherwise(F.floor(c * SCALE) + SHIFT)).alias("x"))


def fit_list(rows: DataFrame) -> DataFrame:
    """(row, x): each distinct vector once, numbered from 0 without gaps.

    Rows are numbered where they were written, and then each part begins where those before it end.
    """
    numbered = materialise(rows.select("x").distinct().withColumn("_n", F.monotonically_increasing_id()))
    part = F.shiftright("_n", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))  # a row a part
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return numbered.withColumn("_part", part).join(F.broadcast(starts), "_part").select((F.col("_start") + F.col("_n").bitwiseAND((1 << 33) - 1)).alias("row"), "x")


def totals(fit: DataFrame, dims: int) -> list[int]:
    """Sums of each dimension."""
    sums = fit.agg(*[F.sum(F.get("x", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]).first()
    return [int(s) for s in sums]


def block_matrix(rows: DataFrame, count: int, dims: int) -> BlockMatrix:
    """(row, v) in blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("row", array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(vectors, count, dims).toBlockMatrix(BLOCK, BLOCK)


def times(a: BlockMatrix, b: BlockMatrix) -> BlockMatrix:
    """a times b. Blocks that are added up into one are shared among tasks, SHARE of each factor in one."""
    tasks = max(1, -(-a.numCols() // (BLOCK * SHARE)))
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, tasks)
    return BlockMatrix(product, BLOCK, BLOCK)


def small_matrix(spark, values: np.ndarray) -> BlockMatrix:
    """A matrix that the driver holds, in blocks."""
    blocks = [((i // BLOCK, j // BLOCK), values[i : i + BLOCK, j : j + BLOCK]) for i in range(0, values.shape[0], BLOCK) for j in range(0, values.shape[1], BLOCK)]
    dense = [(place, DenseMatrix(*v.shape, v.ravel(order="F"))) for place, v in blocks]
    return BlockMatrix(spark.sparkContext.parallelize(dense, len(dense)), BLOCK, BLOCK, *values.shape)


def rows_of(matrix: BlockMatrix) -> DataFrame:
    """(row, v): the rows of a matrix as a DataFrame."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("row"), vector_to_array("vector").alias("v"))


def centred(rows: DataFrame, column: str, means: list[float]) -> DataFrame:
    """(row, v): a column of vectors less their means, a constant array."""
    return rows.select("row", F.zip_with(column, F.array(*map(F.lit, means)), lambda x, m: x - m).alias("v"))


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix: columns by columns, summed over all rows."""
    return np.asarray(times(matrix.transpose(), matrix).toLocalMatrix().toArray())


def eigen(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and their unit vectors in columns; those that are 0 but for rounding are left out.

    The sign of a vector is such that its component of greatest size is positive.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    fine = values > LEAST * max(values[0], 0) if len(values) else np.zeros(0, dtype=bool)
    values, vectors = values[fine], vectors[:, fine]
    top = np.abs(vectors).argmax(axis=0) if vectors.size else np.zeros(0, dtype=int)
    return values, vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def whiten_equal(rows: DataFrame, dims: int, components: int) -> DataFrame | None:
    """Whitened rows (vec_id, x) that all have ``dims`` components; None if no component varies."""
    if dims > DIMS:
        raise ValueError(f"vectors of {dims} components: the driver decomposes {DIMS} at most")
    spark = rows.sparkSession
    fit = materialise(fit_list(rows))
    count = fit.count()
    sums = totals(fit, dims)
    # less a whole number near the mean first, so that nothing is lost where numbers are large
    near = [s // count for s in sums]
    offset = F.zip_with("x", F.array(*[F.lit(n).cast("long") for n in near]), lambda x, n: (x - n).cast("double"))
    means = [float(s - n * count) / count for s, n in zip(sums, near)]
    matrix = block_matrix(centred(fit.select("row", offset.alias("o")), "o", means), count, dims)
    covariance = scatter(matrix) / count
    values, vectors = eigen(covariance, components)
    if not len(values):
        return None
    projected = materialise(rows_of(times(matrix, small_matrix(spark, vectors / np.sqrt(values)))))
    means_of = projected.agg(*[F.avg(F.get("v", F.lit(k))).alias(f"m{k}") for k in range(len(values))]).first()
    again = scatter(block_matrix(centred(projected, "v", list(means_of)), count, len(values))) / count
    error = float(np.abs(again - np.eye(len(values))).max())
    apart = F.zip_with("x", F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums]), lambda x, s: (F.lit(count).cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)") - s)
    squares = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + (d * d).cast("decimal(38,0)")).cast("decimal(38,0)"))
    shares = F.array(*[F.lit(float(v)) for v in values / np.trace(covariance)])
    own = fit.withColumn("deviation", squares).join(projected, "row").select("x", "deviation", "v")
    every = rows.join(own, "x").select("vec_id", "deviation", F.posexplode("v").alias("_k", "whitened"))
    return every.select(
        "vec_id",
        (F.col("_k") + 1).cast("int").alias("component"),
        F.lit(count).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and component, by falling eigenvalue.

    Entries c become floor(64 * c) + 1000000. Means and covariances are those of the n distinct
    vectors. deviation is the sum over dimensions of (n * x - sum of x) ^ 2, exact, as decimal(38,0). explained is
    the component's share of all variance, identity_error the largest entry, without its sign, of
    the whitened vectors' covariance less the identity.

    Vectors that are null or hold null or non-finite entries take no part; entries above 2^30 in
    size raise an error. Each row gives its own result rows, repeated ones and those that share an id or lack one too.
    Components of no variance have no whitened value and are left out: there are none in an empty
    table, for empty vectors, or where all vectors are equal. Vectors of different lengths are whitened by length, each
    with a fit of its own. Of equal eigenvalues any order is right. Other columns are not looked at.
    """
    rows = materialise(whole_vectors(vectors))
    lengths = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())
    parts = [whiten_equal(rows.filter(F.size("x") == dims), dims, components) for dims in lengths if dims > 0]
    kinds = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    out = vectors.sparkSession.createDataFrame([], kinds)
    for part in parts:
        out = out if part is None else out.unionByName(part)
    return out
