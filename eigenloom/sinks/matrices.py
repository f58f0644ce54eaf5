"""Writing matrices and components as Parquet or as text, in ordered part files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.shapes import has_far_cells, is_rows, merge_entries, to_entries, to_rows
from ..sources.committed import write_committed_lines

FORMATS = ("DENSE", "LIL", "COO", "PARQUET")


def write_matrix_rows(matrix: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sparse rows as a Parquet table; entries are gathered into rows first."""
    rows = matrix if is_rows(matrix) else to_rows(matrix)
    rows.write.mode(mode).parquet(path)


def factor_entries(factor: DataFrame) -> DataFrame:
    """(col_id, comp, value) components as matrix entries: one row per column of the data."""
    return factor.select(
        F.col("col_id").cast("long").alias("row_id"), F.col("comp").alias("col_id"), "value"
    )


def _rows_of(matrix: DataFrame, n_rows: int | None) -> DataFrame:
    """Whole sparse rows under the name ``i``; with ``n_rows`` also the rows without a stored cell.

    The segments of a row are put together in column order. A row id outside ``n_rows`` is an error.
    """
    rows = (matrix if is_rows(matrix) else to_rows(matrix)).withColumnRenamed("row_id", "i")
    if not is_rows(matrix) or has_far_cells(rows):
        part = F.sort_array(F.collect_list(F.struct("segment", "indices", "values"))).alias("part")
        rows = rows.groupBy("i").agg(part).select(
            "i", F.flatten("part.indices").alias("indices"), F.flatten("part.values").alias("values")
        )
    rows = rows.select("i", "indices", "values")
    if n_rows is None:
        return rows
    outside = F.raise_error(F.concat_ws(" ", F.lit(f"n_rows={n_rows}, but there is a row"), "i"))
    rows = rows.withColumn("i", F.when((F.col("i") < 0) | (F.col("i") >= n_rows), outside).otherwise(F.col("i")))
    every = matrix.sparkSession.range(n_rows).withColumnRenamed("id", "i")
    none_i, none_x = F.array().cast("array<int>"), F.array().cast("array<double>")
    return every.join(rows, "i", "full_outer").select(
        "i", F.coalesce("indices", none_i).alias("indices"), F.coalesce("values", none_x).alias("values")
    )


def dense_lines(matrix: DataFrame, n_cols: int, n_rows: int | None = None) -> DataFrame:
    """(i, line): all values of a row, each followed by a space."""
    every = F.sequence(F.lit(0), F.lit(n_cols - 1))
    stored = F.transform(
        F.arrays_zip("indices", "values"), lambda c: F.struct(c["indices"].alias("j"), c["values"].alias("v"))
    )
    empty = F.transform(
        F.array_except(every, "indices"), lambda j: F.struct(j.alias("j"), F.lit(0.0).alias("v"))
    )
    cells = F.array_sort(F.concat(stored, empty))
    texts = F.transform("cells", lambda c: F.concat(c["v"].cast("string"), F.lit(" ")))
    beyond = F.raise_error(F.concat_ws(" ", F.lit(f"n_cols={n_cols}, but there is a column"), F.array_max("indices")))
    cells = F.when(F.array_max("indices") >= n_cols, beyond).otherwise(cells)
    rows = _rows_of(matrix, n_rows).select("i", cells.alias("cells"))
    return rows.select("i", F.array_join(texts, "").alias("line"))


def lil_lines(matrix: DataFrame, n_rows: int | None = None) -> DataFrame:
    """(i, line): ``{j:v,j:v}`` per row, zeros left out, ``{}`` for a row without values."""
    pairs = F.transform(
        F.filter(F.arrays_zip("indices", "values"), lambda c: c["values"] != 0),
        lambda c: F.concat(c["indices"].cast("string"), F.lit(":"), c["values"].cast("string")),
    )
    line = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    return _rows_of(matrix, n_rows).select("i", line.alias("line"))


def coo_lines(matrix: DataFrame) -> DataFrame:
    """(i, j, line): ``i,j,v`` per non-zero cell, counted from 0."""
    cells = to_entries(matrix) if is_rows(matrix) else merge_entries(matrix)
    return cells.where("value <> 0").select(
        F.col("row_id").alias("i"),
        F.col("col_id").alias("j"),
        F.concat_ws(",", "row_id", "col_id", "value").alias("line"),
    )


def _write_lines(lines: DataFrame, order: list[str | Column], path: str, mode: str, committed: bool = False) -> None:
    """Part files in row order: a range exchange, then a sort inside each file."""
    lines = lines.sort(*order)
    if committed:
        write_committed_lines(lines.select(F.col("i").alias("row_id"), "line"), path, mode)
    else:
        lines.select("line").write.mode(mode).text(path)


def write_dense_text(
    matrix: DataFrame, path: str, n_cols: int, n_rows: int | None = None, mode: str = "errorifexists", committed: bool = False
) -> None:
    _write_lines(dense_lines(matrix, n_cols, n_rows), ["i"], path, mode, committed)


def write_lil_text(
    matrix: DataFrame, path: str, n_rows: int | None = None, mode: str = "errorifexists", committed: bool = False
) -> None:
    _write_lines(lil_lines(matrix, n_rows), ["i"], path, mode, committed)


def write_coo_text(matrix: DataFrame, path: str, mode: str = "errorifexists", committed: bool = False) -> None:
    _write_lines(coo_lines(matrix), ["i", "j"], path, mode, committed)


def write_components_text(
    factor: DataFrame, path: str, n_comps: int, n_cols: int | None = None, mode: str = "errorifexists"
) -> None:
    """``[v0,v1,...]`` per matrix column, the form ``read_components`` takes."""
    lines = dense_lines(factor_entries(factor), n_comps, n_cols)
    body = F.regexp_replace(F.trim("line"), " ", ",")
    _write_lines(
        lines.select("i", F.concat(F.lit("["), body, F.lit("]")).alias("line")), ["i"], path, mode
    )


def write_matrix(
    matrix: DataFrame,
    fmt: str,
    path: str,
    n_cols: int | None = None,
    n_rows: int | None = None,
    mode: str = "errorifexists",
    committed: bool = False,
) -> str:
    """Write entries, rows or components in one of FORMATS under ``path``; returns the written folder.

    With ``committed`` text goes to a folder whose content changes all at once and that keeps the row ids.
    """
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {FORMATS}")
    if "comp" in matrix.columns:
        matrix = factor_entries(matrix)
    target = f"{path.rstrip('/')}/PCs.{'parquet' if fmt == 'PARQUET' else 'txt'}"
    if fmt == "DENSE":
        if n_cols is None:
            raise ValueError("a dense text needs n_cols")
        write_dense_text(matrix, target, n_cols, n_rows, mode, committed)
    elif fmt == "LIL":
        write_lil_text(matrix, target, n_rows, mode, committed)
    elif fmt == "COO":
        write_coo_text(matrix, target, mode, committed)
    elif committed:
        raise ValueError("committed is for text")
    else:
        write_matrix_rows(matrix, target, mode)
    return target
