"""Exact principal components: through Spark's own PCA for few columns, by Lanczos steps for many."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import DENSE_CELLS, batch_rows
from ..operators.products import vector_batch
from ..operators.shapes import count_rows, first_segment, has_far_cells, is_rows, to_rows
from ..session import as_table, drop_path, fits_broadcast, scratch_path
from .lanczos import FULL, lanczos_in
from .pca import Fit, checked_k
from .spaces import column_signs, declared, factor_table, opened

# Spark's PCA holds a columns x columns covariance, 8 bytes a number, on the driver.
COVARIANCE_BYTES = 512 << 20


def dense_vectors(rows: DataFrame, n_cols: int) -> DataFrame:
    """(vec ARRAY<DOUBLE>): sparse rows written out in full."""

    def job(batches):
        for batch in batches:
            for _, part in batch_rows(batch).below(n_cols).chunks(max(1, DENSE_CELLS // n_cols)):
                yield vector_batch([], [], part.dense(n_cols))

    return rows.select("indices", "values").mapInArrow(job, "vec array<double>")


def row_sums(rows: DataFrame, n_cols: int):
    """The number of rows, and their total variation as a function of the declared number; one scan."""

    def job(batches):
        count, total, square = 0, np.zeros(n_cols), np.zeros(n_cols)
        for batch in batches:
            count += batch.num_rows
            for _, part in batch_rows(batch).pieces(n_cols):
                total += np.bincount(part.index, weights=part.value, minlength=n_cols)
                square += np.bincount(part.index, weights=part.value * part.value, minlength=n_cols)
        columns = [np.arange(-1, n_cols, dtype=np.int32), np.append(float(count), total), np.append(0.0, square)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["col_id", "s", "q"])

    partial = rows.select("indices", "values").mapInArrow(job, "col_id int, s double, q double")
    sums = partial.groupBy("col_id").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).toArrow().sort_by("col_id")
    s, q = (sums[c].to_numpy() for c in ("s", "q"))
    count = round(s[0]) if len(s) else 0
    return count, lambda n: float((q[1:] - s[1:] * s[1:] / n).sum())


def exact_pca(
    matrix: DataFrame,
    k: int,
    n_rows: int | None = None,
    n_cols: int | None = None,
    covariance_bytes: int = COVARIANCE_BYTES,
    method: str = "covariance",
    seed: int = 0,
    rtol: float = 1e-10,
    max_scans: int = 300,
    cache: bool = False,
) -> Fit:
    """The k leading components from the full covariance matrix, or with ``lanczos`` without it.

    ``covariance_bytes`` bounds what the driver holds. The default lets 8,192 columns in as a covariance. For
    ``lanczos`` it bounds a basis and its images, 96 (k + 5) bytes a column: 930,000 columns with k=1, 370,000
    with k=10. That method makes scans, at most ``max_scans``, until each component's residual is below
    ``rtol`` times its squared singular value; values below 1e-6 of the first count as zero.
    """
    if method not in ("covariance", "lanczos"):
        raise ValueError("method must be 'covariance' or 'lanczos'")
    began = time.perf_counter()
    n_rows, n_cols = declared(matrix, n_rows, n_cols)
    if method == "lanczos":
        k = checked_k(k, n_cols)
        width = min(k + 5, n_cols)
        if 2 * 8 * n_cols * min(FULL * width, n_cols) > covariance_bytes or not fits_broadcast(n_cols, width):
            raise ValueError(f"a basis of {FULL * width} columns of length {n_cols} takes more than {covariance_bytes} bytes")
        with opened(matrix, width, n_rows, n_cols, cache=cache) as space:
            return lanczos_in(space, k, seed, rtol, max_scans)
    if n_cols * n_cols * 8 > covariance_bytes:
        raise ValueError(f"the covariance of {n_cols} columns takes more than {covariance_bytes} bytes")
    k = checked_k(k, n_cols)
    spark, path = matrix.sparkSession, None
    if not is_rows(matrix):
        path = scratch_path(spark, "rows")
        # A row with cells past the last column only is a row all the same.
        inside = F.col("col_id") < n_cols
        matrix = matrix.withColumns(
            {"col_id": F.when(inside, F.col("col_id")).otherwise(0), "value": F.when(inside, F.col("value")).otherwise(0.0)}
        )
        rows = as_table(to_rows(matrix), path)
    else:
        rows = first_segment(matrix)
    written, spread_of = row_sums(rows, n_cols)
    present = count_rows(matrix) if is_rows(matrix) and has_far_cells(matrix) else written
    n_rows = present if n_rows is None else n_rows
    if present > n_rows:
        raise ValueError(f"n_rows={n_rows}, but the matrix holds {present} rows")
    vectors = dense_vectors(rows, n_cols)
    absent = n_rows - written
    if absent > 0:
        zero = F.array_repeat(F.lit(0.0), n_cols)
        vectors = vectors.unionByName(matrix.sparkSession.range(absent).select(zero.alias("vec")))
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(
        vectors.select(array_to_vector("vec").alias("features"))
    )
    spread = spread_of(n_rows)
    sigma = np.sqrt(np.maximum(model.explainedVariance.toArray(), 0.0) * spread)
    loadings = model.pc.toArray()
    components = factor_table(spark, loadings * column_signs(loadings))
    if path is not None:
        drop_path(spark, path)
    return Fit(components, sigma, n_rows, n_cols, 1, [], 0.0, [time.perf_counter() - began])
