"""Arrays to matrix entries and back, for the tests."""

import numpy as np


def entries_of(spark, array, n_parts=None):
    """The non-zero cells of an array as matrix entries."""
    cells = [(int(i), int(j), float(array[i, j])) for i, j in zip(*np.nonzero(array))]
    df = spark.createDataFrame(cells, "row_id long, col_id int, value double")
    return df.repartition(n_parts) if n_parts else df


def array_of(df, shape, row="row_id", col="col_id", value="value"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r[row], r[col]] += r[value]
    return out


def components_of(fit, n_cols):
    k = len(fit.sigma)
    return array_of(fit.components, (n_cols, k), "col_id", "comp")
