"""Sums over narrow, full rows as plain column expressions.

A row that goes to Python costs about a microsecond, however short it is. Rows with a cell in each of a few columns
are multiplied and summed where Spark reads them; only sums leave a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

# Columns of a narrow matrix, and sums that one aggregation takes at most: Spark compiles those of fewer than 100.
NARROW_COLUMNS = 8
NARROW_SUMS = 64

# Rows are summed 2^16 at a time, and then the sums: one long sum of like numbers drifts.
BLOCK_BITS = 16


def is_full(rows: DataFrame, n_cols: int) -> bool:
    """Whether every row has just the cells 0 to ``n_cols`` - 1; stops at the first one that has not.

    Where all rows have the same constant ``indices``, as those of ``rows_from_columns``, nothing is read for it.
    """
    every = F.array(*[F.lit(j) for j in range(n_cols)])
    return rows.select("indices").where(~F.col("indices").eqNullSafe(every)).isEmpty()


def narrow_cells(rows: DataFrame, n_cols: int, null: float) -> DataFrame | None:
    """Full rows of a few columns as plain columns y0, y1, ..; None for other rows. ``null`` stands for null values."""
    if n_cols > NARROW_COLUMNS or not is_full(rows, n_cols):
        return None
    value = "coalesce(CAST(get(values, {0}) AS DOUBLE), CAST('{1}' AS DOUBLE)) AS y{0}"
    return rows.selectExpr(*[value.format(j, null) for j in range(n_cols)])


def block_totals(cells: DataFrame, terms: list[str]) -> DataFrame:
    """One row with the sums s0, s1, .. of SQL terms over all rows; 0 where there are none."""
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("_block")
    sums = cells.select(block, "*").groupBy("_block").agg(*[F.expr(f"sum({t}) AS s{k}") for k, t in enumerate(terms)])
    return sums.agg(*[F.expr(f"coalesce(sum(s{k}), 0.0D) AS s{k}") for k in range(len(terms))])


def narrow_column_sums(cells: DataFrame) -> DataFrame:
    """(col_id, value): the sum of each column."""
    n_cols = len(cells.columns)
    pairs = ", ".join(f"named_struct('col_id', {j}, 'value', s{j})" for j in range(n_cols))
    return block_totals(cells, cells.columns).selectExpr(f"inline(array({pairs}))")


def sums_taken(n_cols: int, width: int, cross: bool) -> int:
    return (width + 1) * (width + 2) // 2 + cross * n_cols * (width + 1)


def narrow_scan(cells: DataFrame | None, factor: np.ndarray, shift: np.ndarray, parts: tuple[int, ...]) -> DataFrame | None:
    """(part, i, vec): the Gram matrix of [Z 1] as the first of ``parts``, and Y'[Z 1] as the second if there is one,
    for Z = Y factor - shift. None where that takes too many sums, or numbers that are not finite.
    """
    if cells is None or not (np.isfinite(factor).all() and np.isfinite(shift).all()):
        return None
    (n_cols, width), cross = factor.shape, len(parts) > 1
    if sums_taken(n_cols, width, cross) > NARROW_SUMS:
        return None
    scores = [
        " + ".join(f"y{i} * ({float(factor[i, j])!r}D)" for i in range(n_cols)) + f" - ({float(shift[j])!r}D) AS z{j}"
        for j in range(width)
    ]
    z = [*(f"z{j}" for j in range(width)), "1.0D"]
    terms, place = [], {}
    for i in range(width + 1):
        for j in range(i, width + 1):
            place[0, i, j] = place[0, j, i] = len(terms)
            terms.append(f"{z[i]} * {z[j]}")
    for i in range(n_cols if cross else 0):
        for j in range(width + 1):
            place[1, i, j] = len(terms)
            terms.append(f"y{i} * {z[j]}")
    rows = [
        f"named_struct('part', {part}, 'i', {i}, 'vec', array({', '.join(f's{place[p, i, j]}' for j in range(width + 1))}))"
        for p, part in enumerate(parts)
        for i in range((width + 1, n_cols)[p])
    ]
    return block_totals(cells.selectExpr("*", *scores), terms).selectExpr(f"inline(array({', '.join(rows)}))")
