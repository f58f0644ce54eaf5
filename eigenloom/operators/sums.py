"""Sums over the rows of a matrix: partial sums where the data lies, then one small merge."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.seeds import column_range
from ..functions.vectors import sum_vectors
from ..session import SEGMENT_WIDTH
from .blocks import batch_rows
from .shapes import as_entries, first_segment, is_rows, merge_entries, to_entries


def _per_column(matrix: DataFrame, value: Column, n_cols: int | None = None) -> DataFrame:
    cells = as_entries(matrix)
    if n_cols is not None:
        cells = cells.where(F.col("col_id") < n_cols)
    return cells.groupBy("col_id").agg(F.sum(value).alias("value"))


def column_sums(matrix: DataFrame, n_cols: int | None = None, null: float | None = None) -> DataFrame:
    """(col_id, value): the sum of each column with stored cells, also where they add up to 0.

    Sparse rows of a known, bounded width are summed inside each task before anything is exchanged; ``null``
    stands for null values in them.
    """
    if not is_rows(matrix) or n_cols is None or n_cols > SEGMENT_WIDTH:
        return _per_column(matrix, F.col("value"), n_cols)

    def job(batches):
        total, seen = np.zeros(n_cols), np.zeros(n_cols, dtype=bool)
        for batch in batches:
            for _, part in batch_rows(batch, null).pieces(n_cols):
                total += np.bincount(part.index, weights=part.value, minlength=n_cols)
                seen[part.index] = True
        col = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(col.astype(np.int32)), pa.array(total[col])], names=["col_id", "value"]
        )

    partial = first_segment(matrix).select("indices", "values").mapInArrow(job, "col_id int, value double")
    return partial.groupBy("col_id").agg(F.sum("value").alias("value"))


def column_abs_sums(matrix: DataFrame) -> DataFrame:
    """(col_id, value): the sum of absolute values per column. Repeated entries are merged first."""
    cells = to_entries(matrix) if is_rows(matrix) else merge_entries(matrix)
    return _per_column(cells, F.abs("value"))


def column_means(matrix: DataFrame, n_rows: int, n_cols: int, null: float | None = None) -> DataFrame:
    """(col_id, value) for every column: sum over the declared row count, absent cells being 0."""
    return means_of(column_sums(matrix, n_cols, null).where(F.col("col_id") < n_cols), n_rows, n_cols)


def means_of(sums: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """(col_id, value) for every column, from the sums of those with stored cells."""
    every = column_range(sums.sparkSession, n_cols)
    mean = F.coalesce(F.col("value"), F.lit(0.0)) / F.lit(float(n_rows))
    return every.join(sums, "col_id", "left").select("col_id", mean.alias("value"))


def matrix_sum(*matrices: DataFrame) -> DataFrame:
    """Cell-wise sum of any number of matrices given as entries."""
    return merge_entries(reduce(DataFrame.unionByName, map(as_entries, matrices)))


def score_sums(scores: DataFrame, width: int) -> DataFrame:
    """(comp, value): column sums of packed scores, kept as one short vector until the end."""
    total = sum_vectors(scores, [], width)
    return total.select(F.posexplode("vec").alias("comp", "value"))


def trace(matrix: DataFrame) -> DataFrame:
    """The sum of the diagonal, as a one-row table."""
    diagonal = as_entries(matrix).where("row_id = col_id")
    return diagonal.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def total_variation(matrix: DataFrame, n_rows: int) -> DataFrame:
    """Trace of the centred Gram matrix, from one pass of per-column sums and squares."""
    cells = to_entries(matrix) if is_rows(matrix) else merge_entries(matrix)
    per_column = cells.groupBy("col_id").agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")
    )
    spread = F.col("q") - F.col("s") * F.col("s") / F.lit(float(n_rows))
    return per_column.agg(F.coalesce(F.sum(spread), F.lit(0.0)).alias("value"))
