"""Matrix products as joins and sums, without centring or densifying the data matrix.

A factor is a short, wide-or-tall matrix keyed by column id; scores are the same keyed by row id. Both
travel packed, one ``vec ARRAY<DOUBLE>`` per key, so a product moves one row per stored cell and not
one per cell and component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import dot, numbers, sum_vectors
from ..session import FACTOR_LIMIT_BYTES, SEGMENT_WIDTH, fits_broadcast
from .blocks import DENSE_CELLS, batch_rows, batch_vectors
from .shapes import ENTRIES, as_entries, first_segment, is_rows, merge_entries, to_rows
from .skew import HotKeys, salted_join

SCORES = "row_id long, vec array<double>"


def factor_array(packed: DataFrame, n_cols: int, width: int) -> np.ndarray:
    """A packed factor as an (n_cols, width) array. Callers check ``fits_broadcast`` first."""
    out = np.zeros((n_cols, width))
    for batch in packed.select("col_id", "vec").toArrow().to_batches():
        out[batch.column("col_id").to_numpy(zero_copy_only=False)] = batch_vectors(batch, width)
    return out


def vector_batch(names: list[str], keys: list, vectors: np.ndarray) -> pa.RecordBatch:
    """Key columns and the rows of a 2-d array as an Arrow batch ending in ``vec``."""
    n, width = vectors.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    vec = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(vectors).ravel()))
    return pa.RecordBatch.from_arrays([*(pa.array(k) for k in keys), vec], names=[*names, "vec"])


def project_block(rows: DataFrame, factor: np.ndarray, shift: np.ndarray | None = None) -> DataFrame:
    """Scores of sparse rows against an in-memory factor, less ``shift``; narrow, no exchange."""
    held = rows.sparkSession.sparkContext.broadcast(factor)

    def job(batches):
        for batch in batches:
            factor = held.value
            ids = batch.column("row_id").to_numpy(zero_copy_only=False)
            for start, part in batch_rows(batch).pieces(*factor.shape):
                scores = part.times(factor)
                if shift is not None:
                    scores = scores - shift
                yield vector_batch(["row_id"], [ids[start : start + len(part)]], scores)

    rows = first_segment(rows).select(F.col("row_id").cast("long"), "indices", "values")
    return rows.mapInArrow(job, SCORES)


def project_rows(
    matrix: DataFrame,
    factor: DataFrame,
    n_cols: int,
    width: int,
    limit: int = FACTOR_LIMIT_BYTES,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Y M as packed scores, for a packed factor M.

    Sparse rows against a small factor need no exchange at all. Entries are joined on the column id,
    by broadcast below the size limit and by a salted exchange above it, and summed per row.
    """
    small = fits_broadcast(n_cols, width, limit)
    factor = factor.where(F.col("col_id") < n_cols)
    if is_rows(matrix) and small:
        return project_block(matrix, factor_array(factor, n_cols, width))
    entries = as_entries(matrix)
    if small:
        joined = entries.join(F.broadcast(factor), "col_id")
    else:
        joined = salted_join(entries, factor, "col_id", "row_id", hot)
    return sum_vectors(joined, ["row_id"], width, "value")


def mean_times_matrix(means: DataFrame, factor: DataFrame, width: int) -> DataFrame:
    """The row vector of column means times a packed factor, as (comp, value)."""
    total = sum_vectors(means.join(factor, "col_id"), [], width, "value")
    return total.select(F.posexplode("vec").alias("comp", "value"))


def _cells(ids: np.ndarray, first: int, block: np.ndarray) -> pa.RecordBatch:
    """A dense block of whole rows as entries, its columns counted from ``first``."""
    n, width = block.shape
    columns = np.arange(first, first + width, dtype=np.int32)
    arrays = [pa.array(np.repeat(ids, width)), pa.array(np.tile(columns, n)), pa.array(block.ravel())]
    return pa.RecordBatch.from_arrays(arrays, names=["row_id", "col_id", "value"])


def _small(factor: DataFrame, means: DataFrame | None, n_cols: int, width: int):
    """A factor below the size limit and the column means as arrays; without means, zeros."""
    mean = np.zeros(n_cols)
    if means is not None:
        table = means.where(F.col("col_id") < n_cols).select("col_id", "value").toArrow()
        mean[table["col_id"].to_numpy()] = table["value"].to_numpy()
    return factor_array(factor.where(F.col("col_id") < n_cols), n_cols, width), mean


def reconstruct_rows(
    scores: DataFrame, factor: DataFrame, n_cols: int, width: int, means: DataFrame | None = None
) -> DataFrame:
    """X V' (+ column means) as entries; dense in every row of X, as the product is.

    A factor below the size limit is held by every task: rows are written out where they are, block by
    block of columns, without an exchange. A larger one meets the rows through a join on the column id.
    """
    if fits_broadcast(n_cols, width + 1):
        held = scores.sparkSession.sparkContext.broadcast(_small(factor, means, n_cols, width))

        def job(batches):
            factor, mean = held.value
            step = max(1, DENSE_CELLS // n_cols)
            for batch in batches:
                ids = batch.column("row_id").to_numpy(zero_copy_only=False)
                z = batch_vectors(batch, width)
                for i in range(0, len(ids), step):
                    yield _cells(ids[i : i + step], 0, z[i : i + step] @ factor.T + mean)

        return scores.select(F.col("row_id").cast("long"), "vec").mapInArrow(job, ENTRIES)
    right = factor.where(F.col("col_id") < n_cols).withColumnRenamed("vec", "loading")
    if means is not None:
        right = right.join(means.withColumnRenamed("value", "mean"), "col_id")
    blocks = F.explode(F.sequence(F.lit(0), F.lit((n_cols - 1) // SEGMENT_WIDTH))).alias("block")
    first = F.col("block") * SEGMENT_WIDTH
    last = F.least(first + SEGMENT_WIDTH, F.lit(n_cols)) - 1
    value = dot("vec", "loading", width)
    if means is not None:
        value = value + F.col("mean")
    return (
        scores.select("row_id", "vec", blocks)
        .select("row_id", "vec", F.explode(F.sequence(first, last)).alias("col_id"))
        .join(right, "col_id")
        .select("row_id", "col_id", value.alias("value"))
    )


def row_residual(
    scores: DataFrame,
    factor: DataFrame,
    matrix: DataFrame,
    n_cols: int,
    width: int,
    means: DataFrame | None = None,
) -> DataFrame:
    """X V' - Y - means as entries.

    With a factor below the size limit the scores meet the sparse rows, one of each, and the difference is
    taken inside the task. Else the signed parts of both sides are summed per cell in one exchange.
    """
    if fits_broadcast(n_cols, width + 1):
        return _residual_blocks(scores, factor, matrix, n_cols, width, means)
    rebuilt = reconstruct_rows(scores, factor, n_cols, width)
    if means is not None:
        bias = means.where(F.col("col_id") < n_cols).withColumnRenamed("value", "mean")
        bias = F.broadcast(bias) if fits_broadcast(n_cols, 1) else bias
        rebuilt = rebuilt.join(bias, "col_id").select(
            "row_id", "col_id", (F.col("value") - F.col("mean")).alias("value")
        )
    stored = as_entries(matrix).select("row_id", "col_id", (-F.col("value")).alias("value"))
    return merge_entries(rebuilt.unionByName(stored))


def _residual_blocks(scores, factor, matrix, n_cols: int, width: int, means) -> DataFrame:
    held = scores.sparkSession.sparkContext.broadcast(_small(factor, means, n_cols, width))
    near = matrix if is_rows(matrix) else to_rows(matrix.where(F.col("col_id") < n_cols))
    near = first_segment(near).select(F.col("row_id").cast("long"), "indices", "values")
    joined = scores.select(F.col("row_id").cast("long"), "vec").join(near, "row_id", "full_outer")
    has = F.col("vec").isNotNull().alias("has")
    vec = F.coalesce("vec", F.array_repeat(F.lit(0.0), width)).alias("vec")

    def job(batches):
        factor, mean = held.value
        for batch in batches:
            ids = batch.column("row_id").to_numpy(zero_copy_only=False)
            has, z = batch.column("has").to_numpy(zero_copy_only=False), batch_vectors(batch, width)
            for i, part in batch_rows(batch).below(n_cols).chunks(max(1, DENSE_CELLS // n_cols)):
                own, some = has[i : i + len(part)], ids[i : i + len(part)]
                full = z[i : i + len(part)] @ factor.T - mean - part.dense(n_cols)
                yield _cells(some[own], 0, full[own])
                # Rows without scores have their stored cells only.
                cell = ~own[part.row_of()]
                arrays = [some[part.row_of()[cell]], part.index[cell].astype(np.int32), -part.value[cell]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["row_id", "col_id", "value"])

    inside = joined.select("row_id", vec, has, "indices", "values").mapInArrow(job, ENTRIES)
    beyond = as_entries(matrix).where(F.col("col_id") >= n_cols)
    beyond = merge_entries(beyond.select(F.col("row_id").cast("long"), F.col("col_id").cast("int"), (-F.col("value")).alias("value")))
    return inside.unionByName(beyond)


def shifted(scores: DataFrame, zm: np.ndarray) -> DataFrame:
    """Scores less their mean."""
    return scores.withColumn("vec", F.zip_with("vec", numbers(zm), lambda x, m: x - m))


def cross_product(
    matrix: DataFrame, scores: DataFrame, zm: np.ndarray, hot: HotKeys | None = None
) -> DataFrame:
    """Y'(Z - 1 zm) as a packed factor: entries meet their row's scores and are summed per column."""
    width = len(zm)
    joined = salted_join(as_entries(matrix), shifted(scores, zm), "row_id", "col_id", hot)
    return sum_vectors(joined, ["col_id"], width, "value")


def gram(scores: DataFrame, zm: np.ndarray) -> DataFrame:
    """(Z - 1 zm)'(Z - 1 zm) as packed rows keyed by ``i``: one small array per task, then a sum."""
    width = len(zm)

    def job(batches):
        total = np.zeros((width, width))
        for batch in batches:
            z = batch_vectors(batch, width) - zm
            total += z.T @ z
        yield vector_batch(["i"], [np.arange(width, dtype=np.int32)], total)

    partial = scores.select("vec").mapInArrow(job, "i int, vec array<double>")
    return sum_vectors(partial, ["i"], width)


def mean_correction(cross: DataFrame, means: DataFrame, excess: np.ndarray) -> DataFrame:
    """cross - means x excess: turns Y'Zc into Yc'Zc.

    ``excess`` is the sum of the centred scores over all declared rows, sum(z) - n_rows zm. It is zero
    but for rounding and for a declared mean that is not the mean of the rows.
    """
    mean = F.coalesce(F.col("mean"), F.lit(0.0))
    value = F.zip_with("vec", numbers(excess), lambda x, e: x - mean * e)
    joined = cross.join(means.withColumnRenamed("value", "mean"), "col_id", "full_outer")
    zero = F.array_repeat(F.lit(0.0), len(excess))
    return joined.withColumn("vec", F.coalesce("vec", zero)).select("col_id", value.alias("vec"))
