"""Whitening of embeddings with Spark MLlib's BlockMatrix.

Rows are indexed in place (a partition's offset plus the place in it), centred and cut into distributed blocks. The scatter
matrix is the transpose of the fit list's blocks times the blocks, with the rows dealt to many middle splits; only that matrix
(dimensions squared) reaches the driver, where ``eigh`` decomposes it. The whitening matrix becomes a block again and a block
multiplication projects the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselog.session import durable

SCALE = 256  # fixed value: entries become whole numbers of 1/256
BLOCK_ROWS = 1024
ROWS_A_SPLIT = 16  # row blocks that one task of the scatter multiplies
MOST_DIMENSIONS = 4096  # the scatter matrix of so many takes 128 MB on the driver


def whole_entries(vector: Column) -> Column:
    """floor(256 * c) of every entry as a long; null where the vector is null or holds a null or non-finite entry."""
    number = lambda c: c.cast("double")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(number(c)) | (F.abs(number(c)) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda c: F.floor(number(c) * SCALE).cast("long")))


def _indexed(rows: DataFrame, index: str) -> DataFrame:
    """Rows of a checkpointed table numbered from 0 without a shuffle: start of the partition plus place in it."""
    counts = {r["p"]: r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    place, starts = 0, []
    for p in sorted(counts):
        starts.append((p, place))
        place += counts[p]
    offsets = rows.sparkSession.createDataFrame(starts, "_p int, _start long")
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = rows.withColumns({"_p": F.spark_partition_id(), "_local": local})
    return numbered.join(F.broadcast(offsets), "_p").withColumn(index, F.col("_start") + F.col("_local")).drop("_p", "_start", "_local")


def _blocks(indexed: DataFrame, n: int, fit_rows: int, sums: Column, dims: int) -> BlockMatrix:
    """Blocks of ``BLOCK_ROWS`` centred rows x - S / n; the difference is taken in whole numbers, so it is rounded once.

    The blocks are kept in executor memory or on executor disk, for MLlib reads them several times; a lost one is made anew.
    """
    centred = F.zip_with("x", sums, lambda x, s: (x * fit_rows - s).cast("double") / fit_rows)
    block, place = F.floor(F.col("index") / BLOCK_ROWS).cast("int"), F.col("index") % BLOCK_ROWS
    gathered = indexed.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), centred.alias("row")))).alias("rows"))
    flat = gathered.select("block", F.size("rows").alias("n"), F.flatten(F.col("rows.row")).alias("entries"))
    matrices = flat.rdd.map(lambda r: ((r["block"], 0), DenseMatrix(r["n"], dims, r["entries"], isTransposed=True)))
    return BlockMatrix(matrices, BLOCK_ROWS, dims, n, dims).persist(StorageLevel.MEMORY_AND_DISK)


def _release(blocks: BlockMatrix) -> None:
    blocks._java_matrix_wrapper._java_model.blocks().unpersist(False)


def scatter_matrix(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times blocks; the rows are the middle dimension and are dealt to ``ROWS_A_SPLIT`` row blocks a task."""
    splits = max(1, -(-blocks.numRowBlocks // ROWS_A_SPLIT))
    wrapped = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(wrapped, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def _projected(blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """(index, values): the blocks times a small matrix."""
    spark = SparkSession.getActiveSession()
    small = spark.sparkContext.parallelize([((0, 0), DenseMatrix(*matrix.shape, matrix.ravel(order="F")))], 1)
    out = blocks.multiply(BlockMatrix(small, matrix.shape[0], matrix.shape[1], *matrix.shape)).blocks
    rows = out.flatMap(lambda b: [(b[0][0] * BLOCK_ROWS + i, v) for i, v in enumerate(b[1].toArray().tolist())])
    return spark.createDataFrame(rows, "index long, values array<double>")


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """(id, x, n, deviation, whitened, explained, identity_error) of every usable row.

    Rows whose vector is null or holds a null or non-finite entry are dropped. ``x`` holds floor(256 * c) of the entries, ``n`` is the
    number of distinct x (the fit list), ``deviation`` the exact sum over dimensions of (n * x - S)^2, ``whitened`` the projections on
    the leading components over the root of their eigenvalues, ``explained`` their shares of the trace, ``identity_error`` the largest
    absolute entry of the whitened covariance over the fit list minus the identity. Components without variance (an eigenvalue that
    rounding alone explains) have a null in ``whitened``; vectors of fewer dimensions than ``components`` give fewer. Shorter vectors
    are filled with zeros to the longest, so an empty vector is the origin. Null or repeated ids are rows like any other, a common vector
    is fitted once. Other columns are not looked at. An empty table gives an empty table. More than ``MOST_DIMENSIONS`` dimensions raise.
    """
    vectors = embeddings.select(F.col(f"`{id_col}`").alias("id"), whole_entries(F.col(f"`{vector_col}`")).alias("x")).filter("x is not null")
    dims = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {dims} dimensions, {MOST_DIMENSIONS} at most")
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    rows = durable(vectors.withColumn("x", padded))
    fit = durable(rows.select("x").distinct())
    n, total = fit.count(), rows.count()
    kind = "id %s, x array<long>, n long, deviation long, whitened array<double>, explained array<double>, identity_error double" % rows.schema["id"].dataType.simpleString()
    if n == 0 or dims == 0:
        zero = F.lit(0).cast("long")
        empty = F.array().cast("array<double>")
        return rows.select("id", "x", F.lit(n).cast("long").alias("n"), zero.alias("deviation"), empty.alias("whitened"), empty.alias("explained"),
                           F.lit(None).cast("double").alias("identity_error")).to(rows.sparkSession.createDataFrame([], kind).schema)

    by_place = fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()  # one row a dimension
    sums = F.array(*[F.lit(int(s)).cast("long") for _, s in sorted(by_place)])
    fit_blocks = _blocks(_indexed(fit, "index"), n, n, sums, dims)
    covariance = scatter_matrix(fit_blocks) / n
    values, vectors_ = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    lead, trace = values[order], float(np.trace(covariance))
    real = lead > max(float(values.max()), 0.0) * dims * np.finfo(float).eps
    whitening = vectors_[:, order] / np.sqrt(np.where(real, lead, 1.0))

    error, k = None, int(real.sum())
    if k:
        entries = [F.covar_pop(F.col("values")[i], F.col("values")[j]) - float(i == j) for i in range(k) for j in range(i, k)]
        error = max(abs(v) for v in _projected(fit_blocks, whitening[:, real]).agg(*entries).first())
    _release(fit_blocks)
    indexed = durable(_indexed(rows, "index"))
    all_blocks = _blocks(indexed, total, n, sums, dims)
    projected = durable(_projected(all_blocks, whitening))
    _release(all_blocks)
    square = lambda d: d * d
    gap = F.zip_with("x", sums, lambda x, s: (x * n - s).cast("decimal(19,0)"))
    deviation = F.aggregate(F.transform(gap, square), F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d).cast("decimal(38,0)")).cast("long")
    kept = F.array(*[F.col("values")[i] if ok else F.lit(None).cast("double") for i, ok in enumerate(real)])
    shares = F.array(*[F.lit(float(max(v, 0.0) / trace) if trace > 0 else 0.0) for v in lead])
    return indexed.join(projected, "index").select(
        "id", "x", F.lit(n).cast("long").alias("n"), deviation.alias("deviation"), kept.alias("whitened"), shares.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


def by_component(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per row and component, numbered from 1 by falling eigenvalue."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_c")
    return whitened.select(F.col("id").alias(id_col), "n", "deviation", "identity_error", each).select(
        id_col, (F.col("_at") + 1).alias("component"), "n", "deviation", F.col("_c.whitened").alias("whitened"),
        F.col("_c.explained").alias("explained"), "identity_error")
