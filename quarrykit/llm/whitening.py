"""Whitening of embeddings with Spark's BlockMatrix.

Entries become whole numbers x = floor(256 * c). The vectors, numbered without gaps, stand centred in blocks of rows that
Spark deals over the cluster; the scatter matrix is the transposed BlockMatrix of the fit list times itself, its
eigenvectors are found on the driver (dims x dims), and the BlockMatrix of all rows times the whitening matrix projects
them. The fit list is each distinct x vector once: a vector's first row stands for it, the other rows of the same blocks
are zero there and add nothing. A block holds ROWS rows at least and 32 MB at most, and the middle dimension of the
product is split by blocks, so that a task holds one pair of them however many rows there are; the driver holds a
coordinate for each block. Sums, means and deviations are exact in whole numbers and decimals.

Rows whose vector is null or holds null, NaN or infinite entries are dropped, rows with a null key are kept; vectors of
each length are whitened by themselves, empty ones have no component. Entries beyond what a long holds stay at its ends,
and a deviation beyond it is null. Components whose eigenvalue is nothing beside the largest are left out, so that one
distinct vector has none; an empty table gives no rows. Equal rows get equal figures, each of its own; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarrykit.llm.common import numbered, small, stored, table

SCALE, COMPONENTS = 256, 4
#: Rows of a block at least, entries of one at most, columns of one at most; blocks wanted for many rows.
ROWS, ENTRIES, COLUMNS, BLOCKS = 1024, 1 << 22, 1024, 256
WHOLE, DIGITS = T.DecimalType(19, 0), T.DecimalType(38, 0)
#: The mark of a dense matrix in Spark's matrix type.
DENSE = 1
BLOCK = T.StructType([T.StructField("blockIndex", T.StructType([T.StructField("row", T.LongType()), T.StructField("column", T.LongType())])), T.StructField("subMatrix", MatrixUDT())])


def scaled(vectors: DataFrame, key: str, column: str, scale: int = SCALE) -> DataFrame:
    """(key, x, dims) of the rows whose vector is there and finite; x holds longs."""
    c = F.col(column)
    fine = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    # Java's conversion of what floor gives: whole numbers that do not fit a long stay at its ends
    x = F.transform(c, lambda v: F.floor(v.cast("double") * scale))
    return vectors.filter(fine).select(F.col(key).alias("key"), x.alias("x"), F.size(c).alias("dims"))


def block_rows(rows: int, dims: int) -> int:
    """Rows of a block: so many that there are about BLOCKS blocks, within what a block holds."""
    return max(1, min(ENTRIES // min(dims, COLUMNS), max(ROWS, -(-rows // BLOCKS))))


def blocks(rows: DataFrame, mean: np.ndarray, total: int, height: int) -> DataFrame:
    """(blockIndex, subMatrix): rows (index, x) less ``mean`` in blocks of ``height`` rows; rows that are not there are zero."""
    dims = len(mean)

    schema = to_arrow_schema(BLOCK)

    def build(part: pa.Table) -> pa.Table:
        at, x = part["block"][0].as_py(), part["x"].combine_chunks()
        whole = np.zeros((min(height, total - at * height), dims))
        whole[part["index"].to_numpy() - at * height] = x.flatten().to_numpy().reshape(-1, dims) - mean
        cut = [whole[:, c : c + COLUMNS] for c in range(0, dims, COLUMNS)]
        said = [{"type": DENSE, "numRows": m.shape[0], "numCols": m.shape[1], "values": m.ravel(order="F"), "isTransposed": False} for m in cut]
        return pa.Table.from_arrays([pa.array([{"row": at, "column": j} for j in range(len(cut))], schema.types[0]), pa.array(said, schema.types[1])], schema=schema)

    return rows.select("index", "x", F.floor(F.col("index") / height).alias("block")).groupBy("block").applyInArrow(build, BLOCK)


def matrix_of(blocks: DataFrame, height: int, width: int, rows: int, columns: int) -> BlockMatrix:
    """The BlockMatrix of a DataFrame of blocks; its constructor takes only RDDs, which Python would unpack and pack again."""
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, height, width, rows, columns), height, width)


def times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product, whose middle dimension is dealt over ``splits`` tasks; the Python call leaves that argument out."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def components(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The whitening matrix (dims x k) and each component's share of the variance."""
    covariance = (scatter + scatter.T) / (2 * n)
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1], v[:, ::-1]
    keep = [i for i in range(min(most, len(e))) if e[i] > max(len(e), 16) * np.finfo(float).eps * e[0] > 0]
    return v[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(covariance)


@F.udf(T.ArrayType(T.ArrayType(T.DoubleType())), useArrow=False)
def unpacked(matrix: DenseMatrix) -> list[list[float]]:
    return matrix.toArray().tolist()


def whitened(rows: DataFrame, dims: int, most: int) -> DataFrame | None:
    """(key, component, n, deviation, whitened, explained, identity_error) of rows (key, x) of one length."""
    rows = numbered(rows, "whitening")
    total = rows.count()
    fit = stored(rows.groupBy("x").agg(F.min("index").alias("index")), "whitening-fit")
    found = fit.agg(F.count("*"), *[F.sum(F.col("x")[i].cast(WHOLE)) for i in range(dims)]).first()
    n, sums = found[0], [int(s) for s in found[1:]]
    mean, height = np.array([s / n for s in sums]), block_rows(total, dims)
    width, tall = min(dims, COLUMNS), -(-total // height)
    kept = blocks(fit, mean, total, height).persist()
    centred = matrix_of(kept, height, width, total, dims)
    matrix, explained = components(times(centred.transpose(), centred, tall).toLocalMatrix().toArray(), n, most)
    kept.unpersist()
    k = len(explained)
    if not k:
        return None
    spark = rows.sparkSession
    across = [((i // width, 0), DenseMatrix(len(m), k, m.ravel(order="F"))) for i in range(0, dims, width) for m in [matrix[i : i + width]]]
    right = matrix_of(spark.createDataFrame(across, BLOCK), width, k, dims, k)
    kept = blocks(rows, mean, total, height).persist()
    product = times(matrix_of(kept, height, width, total, dims), right, 1)
    there = callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model).toDF("at", "matrix").select(F.col("at._1").cast("long").alias("block"), F.posexplode(unpacked("matrix")).alias("at", "whitened"))
    projected = stored(there.select((F.col("block") * height + F.col("at")).alias("index"), "whitened"), "whitening-projected")
    kept.unpersist()

    first = projected.join(small(fit.select("index")), "index", "left_semi").select(*[F.col("whitened")[i].alias(f"c{i}") for i in range(k)])
    spread = first.agg(*[F.covar_pop(f"c{i}", f"c{j}") for i in range(k) for j in range(i + 1)]).first()
    error = max(abs(value - (i == j)) for value, (i, j) in zip(spread, [(i, j) for i in range(k) for j in range(i + 1)], strict=True))

    none = F.lit(0).cast(DIGITS)
    away = F.zip_with("x", F.array(*[F.lit(s).cast(DIGITS) for s in sums]), lambda x, s: F.try_subtract(F.try_multiply(x.cast(WHOLE), F.lit(n).cast(WHOLE)).cast(DIGITS), s))
    deviation = F.aggregate(away, none, lambda a, d: F.try_add(a, F.try_multiply(d, d).cast(DIGITS)).cast(DIGITS))
    of_row = rows.select("index", "key", deviation.alias("deviation")).join(projected, "index")
    shares = F.array(*[F.lit(float(x)) for x in explained])
    each = of_row.select("key", "deviation", F.posexplode(F.arrays_zip("whitened", shares.alias("explained"))).alias("at", "one"))
    return each.select("key", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "one.whitened", "one.explained", F.lit(float(error)).alias("identity_error"))


def whiten(vectors: DataFrame, key: str, column: str, most: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(key, dims, component, n, deviation, whitened, explained, identity_error); the deviation is a decimal, null beyond 38 digits."""
    rows = stored(scaled(vectors, key, column, scale), "whitening-scaled")
    none = rows.sparkSession.createDataFrame([], f"key {dict(rows.dtypes)['key']}, dims int, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    for (dims,) in sorted(rows.select("dims").filter("dims > 0").distinct().collect()):
        found = whitened(rows.filter(F.col("dims") == dims).select("key", "x"), dims, most)
        if found is not None:
            none = none.unionByName(found.withColumn("dims", F.lit(dims)))
    return none.withColumnRenamed("key", key)


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.select("vec_id", "component", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", "explained", "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_whiten": op13_whiten}
#: None: eigenvectors have no SQL form; tests compare with a plain computation.
ORACLE_SQL: dict[str, str] = {}
