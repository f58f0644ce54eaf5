"""The two table shapes of a matrix and the row-wise operators on them.

entries   (row_id LONG, col_id INT, value DOUBLE): one row per stored cell. Several rows for the same
          cell add up, unless an operator says otherwise. Either id may be INT or LONG.
rows      (row_id LONG, segment INT, indices ARRAY<INT>, values ARRAY<DOUBLE>): the stored cells of
          one matrix row in column order, cut into segments of SEGMENT_WIDTH columns so that no
          array grows without bound. A matrix of up to SEGMENT_WIDTH columns has one segment per row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.seeds import uniform
from ..session import SEGMENT_WIDTH
from .blocks import DENSE_CELLS, batch_rows

ENTRIES = "row_id long, col_id int, value double"


def is_rows(df: DataFrame) -> bool:
    return "indices" in df.columns


def entries_from(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Any relational table as matrix entries; a pure projection.

    Integer ids keep their type, so that a test on ``row_id`` or ``col_id`` still reaches the scan.
    """
    return df.select(
        F.col(row).alias("row_id"), F.col(col).alias("col_id"), F.col(value).cast("double").alias("value")
    )


def has_far_cells(rows: DataFrame) -> bool:
    """Whether some row goes on past the first segment; stops at the first one found."""
    return "segment" in rows.columns and bool(rows.where("segment > 0").limit(1).count())


def count_rows(matrix: DataFrame) -> int:
    """Matrix rows present, those with zeros only included."""
    if is_rows(matrix) and not has_far_cells(matrix):
        return matrix.count()
    return matrix.select("row_id").distinct().count()


def first_segment(rows: DataFrame) -> DataFrame:
    """The cells of rows under SEGMENT_WIDTH: all of them, for a matrix that is no wider."""
    return rows.where("segment = 0") if "segment" in rows.columns else rows


def rows_from_columns(df: DataFrame, columns: list, row: str | None = None) -> DataFrame:
    """Numeric columns of a table as dense matrix rows, without a shuffle."""
    key = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    cells = [F.col(c) if isinstance(c, str) else c for c in columns]
    return df.select(
        key.alias("row_id"),
        F.lit(0).alias("segment"),
        F.array(*[F.lit(i) for i in range(len(cells))]).alias("indices"),
        F.array(*[c.cast("double") for c in cells]).alias("values"),
    )


def rows_from_array(df: DataFrame, row: str, column: str) -> DataFrame:
    """An array column as dense matrix rows, without a shuffle."""
    return df.select(
        F.col(row).cast("long").alias("row_id"),
        F.lit(0).alias("segment"),
        F.transform(F.col(column), lambda x, i: i).alias("indices"),
        F.col(column).cast("array<double>").alias("values"),
    )


def merge_entries(entries: DataFrame) -> DataFrame:
    """One row per cell: repeated cells are added up, map side first."""
    return entries.groupBy("row_id", "col_id").agg(F.sum("value").alias("value"))


def to_rows(entries: DataFrame, merged: bool = False, segment: int = SEGMENT_WIDTH) -> DataFrame:
    """Entries to sparse rows. A group is one row's segment: at most ``segment`` cells.

    Zero cells are not stored, but a row of which only zeros are left is still a row, without cells.
    ``merged=True`` promises one entry per cell and saves a shuffle.
    """
    cells = entries if merged else merge_entries(entries)
    cells = cells.withColumn("segment", F.floor(F.col("col_id") / segment).cast("int"))
    cell = F.struct(F.col("col_id").cast("int").alias("col_id"), "value")
    stored = F.collect_list(F.when(F.col("value") != 0, cell))
    grouped = cells.groupBy("row_id", "segment").agg(F.sort_array(stored).alias("cells"))
    return grouped.select(
        F.col("row_id").cast("long").alias("row_id"),
        "segment",
        F.col("cells.col_id").alias("indices"),
        F.col("cells.value").alias("values"),
    )


def to_entries(rows: DataFrame) -> DataFrame:
    """Sparse rows back to entries; a narrow explode."""
    cell = F.explode(F.arrays_zip("indices", "values"))
    return rows.select("row_id", cell.alias("cell")).select(
        "row_id", F.col("cell.indices").alias("col_id"), F.col("cell.values").alias("value")
    )


def as_entries(matrix: DataFrame) -> DataFrame:
    return to_entries(matrix) if is_rows(matrix) else matrix


def cap_columns(matrix: DataFrame, n_cols: int) -> DataFrame:
    """Keep the non-zero cells with ``col_id < n_cols``; on entries the test reaches the scan."""
    if not is_rows(matrix):
        return matrix.where((F.col("col_id") < n_cols) & (F.col("value") != 0))
    kept = F.filter(
        F.arrays_zip("indices", "values"),
        lambda cell: (cell["indices"] < n_cols) & (cell["values"] != 0),
    )
    cells = {"indices": F.col("_cells.indices"), "values": F.col("_cells.values")}
    return matrix.withColumn("_cells", kept).withColumns(cells).drop("_cells")


def limit_columns(entries: DataFrame, max_col: int) -> DataFrame:
    """Drop the entries whose column id lies above ``max_col``."""
    return entries.where(F.col("col_id") <= max_col)


def rebase_columns(entries: DataFrame, base: int) -> DataFrame:
    """Column ids counted from ``base`` to ids counted from 0; row ids stay."""
    return entries.withColumn("col_id", F.col("col_id") - base)


def sample_rows(matrix: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Keep about a ``rate`` share of the matrix rows; whole rows, the same ones on every run."""
    if not 0.0 <= rate <= 1.0:
        raise ValueError("rate must lie in [0, 1]")
    return matrix.where(uniform(seed, "row_id") < rate)


def dimensions(matrix: DataFrame) -> tuple[int, int]:
    """(rows present, largest column id + 1), from the id columns only."""
    if is_rows(matrix):
        segment = F.max("segment") if "segment" in matrix.columns else F.lit(0)
        found = matrix.agg(
            F.count(F.lit(1)).alias("n"), F.max(F.array_max("indices")).alias("last"), segment.alias("far")
        ).first()
        n = found["n"] if not found["far"] else matrix.select("row_id").distinct().count()
    else:
        per_row = matrix.groupBy("row_id").agg(F.max("col_id").alias("last"))
        found = per_row.agg(F.count(F.lit(1)).alias("n"), F.max("last").alias("last")).first()
        n = found["n"]
    return n, 0 if found["last"] is None else found["last"] + 1


def every_segment(rows: DataFrame, n_cols: int) -> DataFrame:
    """Every segment under ``n_cols`` of every row present, with or without cells."""
    last = (n_cols - 1) // SEGMENT_WIDTH
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), "segment", "indices", "values")
    every = rows.select("row_id").distinct()
    every = every.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("segment"))
    return every.join(rows, ["row_id", "segment"], "left")


def center_rows(rows: DataFrame, mu: np.ndarray) -> DataFrame:
    """Every cell of every present row minus its column mean, as entries.

    The result is dense by nature, one segment of a row after the other. Wide or huge matrices are
    centred implicitly instead, inside the products; this operator is for matrices that are to be
    written out.
    """
    n_cols = len(mu)
    if n_cols > SEGMENT_WIDTH or has_far_cells(rows):
        rows = every_segment(rows, n_cols)
    else:
        rows = rows.select(F.col("row_id").cast("long"), F.lit(0).alias("segment"), "indices", "values")
    held = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(mu, dtype=np.float64))

    def job(batches):
        for batch in batches:
            segments = batch.column("segment").to_numpy(zero_copy_only=False)
            for segment in np.unique(segments):
                some = batch.filter(pa.array(segments == segment))
                first = int(segment) * SEGMENT_WIDTH
                mean = held.value[first : first + SEGMENT_WIDTH]
                columns = np.arange(first, first + len(mean), dtype=np.int32)
                ids = some.column("row_id").to_numpy(zero_copy_only=False)
                block = batch_rows(some)
                block.index = block.index - first
                for start, part in block.below(len(mean)).chunks(max(1, DENSE_CELLS // len(mean))):
                    full = part.dense(len(mean)) - mean
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(ids[start : start + len(part)], len(mean))),
                            pa.array(np.tile(columns, len(part))),
                            pa.array(full.ravel()),
                        ],
                        names=["row_id", "col_id", "value"],
                    )

    return rows.mapInArrow(job, ENTRIES)
