"""Where the column-by-sketch factor lives while a sketch is being refined.

``LocalSpace`` keeps it as one array that every task receives by broadcast; a pass is then a single
scan of the rows, and only per-task sums are exchanged. ``ScanSpace`` keeps it as a table that the scan tasks
read themselves, so that it never reaches the driver. ``TableSpace`` keeps it as a table and makes a pass out of
joins and sums; it has no bound on the number of columns. All offer the same steps, so the methods in this
package are written once. Only sketch-sized (width x width) arrays are common to all.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.seeds import column_range, gaussian_seed, gaussian_vectors, sign_vectors, sparse_sign_seed
from ..functions.vectors import numbers, pack, sum_vectors, unpack
from ..operators import products, tsqr
from ..operators.blocks import batch_rows, batch_vectors
from ..operators.narrow import narrow_cells, narrow_column_sums, narrow_scan
from ..operators.shapes import (
    as_entries,
    count_rows,
    dimensions,
    first_segment,
    has_far_cells,
    is_rows,
    merge_entries,
    to_entries,
    to_rows,
)
from ..operators.sums import column_means, column_sums, means_of
from ..operators.products import vector_batch
from ..session import FACTOR_LIMIT_BYTES, as_table, drop_path, fits_broadcast, full_path, scratch_path
from ..sources.files import data_files, file_system
from .tiles import Tiles

CROSS, GRAM = range(2)
FACTOR = "col_id int, vec array<double>"
PARTIAL = "part int, i int, vec array<double>"

# A stored factor up to this size is read by every scan task, which also holds a sum as large; and the longest row
# that a scan takes as one array.
HELD_BYTES = 768 << 20
HELD_COLUMNS = 1 << 23

# Planned bytes of rows that a scan task has at least, however narrow the factor.
SCAN_BYTES = 1 << 20

# Eigenvalues of a Gram matrix at or below this share of the largest count as zero.
RANK_TOLERANCE = 1e-12

# Singular values below this share of sqrt(n_rows) |means| are what rounding leaves of the centring.
ROUND_OFF = 1e-14

# A first scan may take its sums without means and centre them afterwards, as long as this share of
# every squared score norm is left; a mean that outweighs the spread is taken off before summing.
CENTRE_AFTER = 1e-3

# Singular values that spread more than this take a second round of orthogonalization.
SPREAD = 1e-4

# Entries this close to the largest one, relative to it, count as equally large.
TIE = 1e-9


@contextmanager
def opened(
    matrix: DataFrame,
    width: int,
    n_rows: int | None,
    n_cols: int,
    limit: int = FACTOR_LIMIT_BYTES,
    cache: bool = False,
    partitions: int | None = None,
):
    """A space for sketches of up to the given width: local when the factor passes the size check.

    A larger factor is a table: one that scan tasks read, or, when they could not hold it, one that is joined.
    """
    width = min(width, n_cols)
    if fits_broadcast(n_cols, width, limit):
        space = LocalSpace(matrix, n_rows, n_cols, cache, partitions, 8 * n_cols * width)
    elif n_cols <= HELD_COLUMNS and 8 * n_cols * width <= HELD_BYTES:
        space = ScanSpace(matrix, n_rows, n_cols, width)
    else:
        space = TableSpace(matrix, n_rows, n_cols, width)
    try:
        yield space
    finally:
        space.close()


def declared(
    matrix: DataFrame, n_rows: int | None, n_cols: int | None
) -> tuple[int | None, int]:
    """Given dimensions, or the ones found in the data. Absent all-zero rows need ``n_rows``.

    With ``n_cols`` given, an open row count costs no job here: the first pass counts the rows.
    """
    if n_cols is None:
        present, n_cols = dimensions(matrix)
        if n_rows is not None and n_rows < present:
            raise ValueError(f"n_rows={n_rows}, but the matrix holds {present} rows")
        n_rows = present if n_rows is None else n_rows
    if n_cols < 1 or (n_rows is not None and n_rows < 1):
        raise ValueError("the matrix is empty")
    return n_rows, n_cols


def planned_bytes(rows: DataFrame) -> int:
    """Bytes the optimizer expects a plan to read: for files, their size; else often a huge guess."""
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def scan_tasks(size: int, factor_bytes: int) -> int:
    """At most so many scan tasks for ``size`` bytes of rows; each one sends a sum as large as the factor.

    A task reads 32 times the factor, but at least 1 MB and no more than 128 MB for that; four times the factor if
    that is more, and never above 1 GB: so what is exchanged stays below a quarter of what is read, and no task is
    too large to be run again. The cores of the moment have no say. Planned bytes are those of packed columns, some
    two for a row of five cells: for a narrow factor the tasks are the splits that Spark plans.
    """
    least = min(max(32 * factor_bytes, SCAN_BYTES), 128 << 20)
    return max(1, -(-size // min(max(4 * factor_bytes, least), 1 << 30)))


def factor_table(spark: SparkSession, factor: np.ndarray) -> DataFrame:
    """An (n_cols, width) array as (col_id, comp, value)."""
    n_cols, width = factor.shape
    cells = pa.table(
        {
            "col_id": np.repeat(np.arange(n_cols, dtype=np.int32), width),
            "comp": np.tile(np.arange(width, dtype=np.int32), n_cols),
            "value": np.ascontiguousarray(factor).ravel(),
        }
    )
    return spark.createDataFrame(cells)


def column_signs(factor: np.ndarray) -> np.ndarray:
    """Signs that make each column's entry of largest size positive (the first one on ties)."""
    size = np.abs(factor)
    top = (size >= (1 - TIE) * size.max(axis=0)).argmax(axis=0)
    return np.where(factor[top, np.arange(factor.shape[1])] < 0, -1.0, 1.0)


class LocalSpace:
    def __init__(
        self,
        matrix: DataFrame,
        n_rows: int | None,
        n_cols: int,
        cache: bool = False,
        partitions: int | None = None,
        factor_bytes: int = FACTOR_LIMIT_BYTES,
    ):
        self.spark, self.n_rows, self.n_cols = matrix.sparkSession, n_rows, n_cols
        self.path = None
        if not is_rows(matrix):
            self.path = scratch_path(self.spark, "rows")
            matrix = as_table(to_rows(every_row(matrix, n_cols)), self.path)
        elif has_far_cells(matrix):
            near, found = first_segment(matrix), count_rows(matrix)
            if n_rows is not None and found > n_rows:
                raise ValueError(f"n_rows={n_rows}, but the matrix holds {found} rows")
            self.n_rows = found if n_rows is None else n_rows
            matrix = near
        rows = first_segment(matrix).select("indices", "values")
        if partitions:
            self.rows = rows.repartition(partitions)
        else:
            tasks = scan_tasks(planned_bytes(rows), factor_bytes)
            self.rows = rows.coalesce(min(tasks, (1 << 31) - 1))
        self.cached = self.rows.persist() if cache else None
        self.cells = narrow_cells(self.rows if cache or partitions else rows, n_cols, np.nan)
        self.means = None

    @property
    def noise(self) -> float:
        if self.means is None:
            return 0.0
        return ROUND_OFF * np.sqrt(self.n_rows) * float(np.linalg.norm(self.means))

    def find_means(self) -> None:
        sums = narrow_column_sums(self.cells) if self.cells is not None else column_sums(self.rows, self.n_cols)
        table = sums.toArrow()
        self.means = np.zeros(self.n_cols)
        self.means[table["col_id"].to_numpy()] = table["value"].to_numpy() / self.n_rows

    def absent(self, present: int) -> int:
        """Declared rows without a stored cell. An undeclared row count becomes the one found."""
        if self.n_rows is None:
            self.n_rows = present
        if not self.n_rows:
            raise ValueError("the matrix is empty")
        if present > self.n_rows:
            raise ValueError(f"n_rows={self.n_rows}, but the matrix holds {present} rows")
        return self.n_rows - present

    def close(self) -> None:
        if self.cached is not None:
            self.cached.unpersist()
        if self.path is not None:
            drop_path(self.spark, self.path)

    def keep_only(self, *factors: np.ndarray) -> None:
        """Nothing is stored between steps."""

    def start(self, width: int, seed: int, signs: int = 0) -> np.ndarray:
        if signs:
            return sign_vectors(np.arange(self.n_cols), width, seed, signs)
        return self.load(gaussian_seed(column_range(self.spark, self.n_cols), width, seed), width)

    def load(self, factor: DataFrame, width: int) -> np.ndarray:
        cells = factor.select("col_id", "comp", "value").toArrow()
        out = np.zeros((self.n_cols, width))
        out[cells["col_id"].to_numpy(), cells["comp"].to_numpy()] = cells["value"].to_numpy()
        return out

    def table(self, factor: np.ndarray) -> DataFrame:
        return factor_table(self.spark, factor)

    def kept_means(self) -> DataFrame:
        """(col_id, value) of the means, or no rows while they are not known."""
        means = np.zeros(0) if self.means is None else self.means
        cells = pa.table({"col_id": np.arange(len(means), dtype=np.int32), "value": means})
        return self.spark.createDataFrame(cells)

    def take_means(self, means: DataFrame, n_rows: int) -> None:
        """Means and row count found by an earlier run, so that a fit goes on as it would have."""
        self.n_rows, found = n_rows, means.toArrow()
        if found.num_rows:
            self.means = np.zeros(self.n_cols)
            self.means[found["col_id"].to_numpy()] = found["value"].to_numpy()

    def scan(self, factor: np.ndarray, shift: np.ndarray, cross: bool):
        """[Z 1]'[Z 1] and, with ``cross``, Y'[Z 1] for Z = Y factor - shift, over the rows present."""
        n_cols, width = factor.shape
        held = self.spark.sparkContext.broadcast(factor)

        def job(batches):
            yield from scan_sums((batch_rows(b) for b in batches), held.value, shift, cross)

        sums = narrow_scan(self.cells, factor, shift, (GRAM, CROSS) if cross else (GRAM,))
        if sums is None:
            sums = sum_vectors(self.rows.mapInArrow(job, PARTIAL), ["part", "i"], width + 1)
        whole = [np.zeros((n, width + 1)) for n in (n_cols if cross else 0, width + 1)]
        for batch in sums.toArrow().to_batches():
            part = batch.column("part").to_numpy(zero_copy_only=False)
            i, vec = batch.column("i").to_numpy(zero_copy_only=False), batch_vectors(batch, width + 1)
            for p in (CROSS, GRAM):
                whole[p][i[part == p]] = vec[part == p]
        held.destroy()
        return whole[CROSS], whole[GRAM]

    def sketch(self, factor: np.ndarray, gram: bool = True, cross: bool = True):
        """(Yc'Zc, Zc'Zc) for Zc = Yc factor, in one scan of the rows.

        The means need no scan of their own: the first cross product brings the column sums along,
        and its sums are centred afterwards unless that would cost digits.
        """
        width = factor.shape[1]
        if self.means is None:
            y_cross, z_gram = self.scan(factor, np.zeros(width), cross)
            self.absent(round(z_gram[-1, -1]))
            raw, zm = z_gram[:-1, :-1], z_gram[-1, :-1] / self.n_rows
            centred = raw - self.n_rows * np.outer(zm, zm)
            if (centred.diagonal() >= CENTRE_AFTER * raw.diagonal()).all():
                if not cross:
                    return None, centred
                self.means = y_cross[:, -1] / self.n_rows
                return y_cross[:, :-1] - self.n_rows * np.outer(self.means, zm), centred
            self.find_means()
        zm = self.means @ factor
        y_cross, z_gram = self.scan(factor, zm, cross)
        # Absent rows are zero rows: z - zm is -zm there, and y adds nothing.
        absent = self.absent(round(z_gram[-1, -1]))
        centred = z_gram[:-1, :-1] + absent * np.outer(zm, zm)
        if not cross:
            return None, centred
        excess = z_gram[-1, :-1] - absent * zm
        return y_cross[:, :-1] - np.outer(self.means, excess), centred

    def stack_r(self, factor: np.ndarray, fan_in: int = tsqr.FAN_IN) -> np.ndarray:
        """R of the QR factorisation of Zc, absent rows included.

        With a column of ones ahead of Z, what is left of R below its first row belongs to Z less its
        mean; an absent row is a one followed by zeros.
        """
        n_cols, width = factor.shape
        held = self.spark.sparkContext.broadcast(factor)

        def job(batches):
            yield from tsqr.task_r(scores_with_ones((batch_rows(b) for b in batches), held.value), width + 1, fan_in)

        parts = self.rows.mapInArrow(job, tsqr.PARTS)
        r = small_rows(tsqr.tree_r(parts, width + 1, fan_in), "i", width + 1)
        held.destroy()
        absent = self.absent(round(r[0, 0] ** 2) if len(r) else 0)
        return add_absent(r, absent, np.eye(1, width + 1)[0])[1:, 1:]

    def times(self, factor: np.ndarray, small: np.ndarray) -> np.ndarray:
        return factor @ small

    def inner(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.T @ right

    def less(self, factor: np.ndarray, other: np.ndarray, small: np.ndarray) -> np.ndarray:
        """factor - other @ small"""
        return factor - other @ small

    def signs(self, factor: np.ndarray) -> np.ndarray:
        return column_signs(factor)

    def svd(self, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Left singular vectors and singular values, in falling order."""
        u, sigma, _ = np.linalg.svd(factor, full_matrices=False)
        return u, sigma


@dataclass(frozen=True)
class Factor:
    """A packed factor (col_id, vec) that stays a table; ``path`` holds the stored one it is read from.

    A start that is a function of the column ids has it in ``vectors``: tasks then need no table. With ``turn``,
    the factor is the stored one, or the start, times that small matrix.
    """

    df: DataFrame
    width: int
    path: str
    vectors: Callable[[np.ndarray], np.ndarray] | None = None
    turn: np.ndarray | None = None


class TableSpace:
    """Every step is a join and a sum; results are written to the scratch folder between steps.

    The matrix is stored once as tiles (see ``tiles``); after that only factors and scores are exchanged.
    """

    def __init__(self, matrix: DataFrame, n_rows: int | None, n_cols: int, width: int = 32):
        self.spark, self.n_cols = matrix.sparkSession, n_cols
        self.base, self.steps = [], []
        cells = as_entries(matrix)
        if not is_rows(matrix):
            cells = merge_entries(cells)
        cells = cells.where((F.col("col_id") < n_cols) & (F.col("value") != 0)).select(
            F.col("row_id").cast("long"), F.col("col_id").cast("int"), "value"
        )
        # Cells are counted before they are placed: what needs merging, or could differ from job to job, is
        # written for that.
        fixed = is_rows(matrix) and matrix._jdf.queryExecution().analyzed().deterministic()
        held: list[str] = []
        self.tiles = Tiles.store(cells if fixed else self.stored(cells, "entries", held)[0], width)
        self.drop(held)
        if n_rows is None:
            n_rows = count_rows(matrix)
        self.n_rows = n_rows
        self.means, _ = self.stored(column_means(self.tiles.cells(), n_rows, n_cols), "means", self.base)
        square = self.means.agg(F.sum(F.col("value") * F.col("value"))).first()[0]
        self.noise = ROUND_OFF * np.sqrt(n_rows * square)

    def stored(self, df: DataFrame, name: str, paths: list[str]) -> tuple[DataFrame, str]:
        path = scratch_path(self.spark, name)
        paths.append(path)
        return as_table(df, path), path

    def stored_factor(self, df: DataFrame, width: int) -> Factor:
        table, path = self.stored(df, "factor", self.steps)
        return Factor(table, width, path)

    def drop(self, paths: list[str]) -> None:
        for path in paths:
            drop_path(self.spark, path)

    def close(self) -> None:
        self.tiles.drop()
        self.drop(self.base + self.steps)

    def keep_only(self, *factors: Factor) -> None:
        """Delete the tables of earlier steps, but for those the given factors are read from."""
        kept = {factor.path for factor in factors}
        self.drop([path for path in self.steps if path not in kept])
        self.steps = [path for path in self.steps if path in kept]

    def start(self, width: int, seed: int, signs: int = 0) -> Factor:
        if signs:
            cells = sparse_sign_seed(column_range(self.spark, self.n_cols), width, seed, signs)
            return Factor(pack(cells, "col_id", width), width, "", lambda ids: sign_vectors(ids, width, seed, signs))
        vectors = gaussian_vectors(column_range(self.spark, self.n_cols), width, seed)
        return self.stored_factor(vectors, width)

    def load(self, factor: DataFrame, width: int) -> Factor:
        cells = factor.withColumn("col_id", F.col("col_id").cast("int"))
        return self.stored_factor(pack(cells, "col_id", width), width)

    def table(self, factor: Factor) -> DataFrame:
        """(col_id, comp, value) in a table of its own, which outlives the space."""
        return as_table(unpack(factor.df, "col_id"), scratch_path(self.spark, "components"))

    def scores(self, factor: Factor) -> tuple[DataFrame, np.ndarray]:
        """Stored scores and their declared mean."""
        if factor.vectors:
            scores = self.tiles.project_seed(factor.vectors, factor.width)
            zm = self.mean_scores(factor)
        else:
            scores = self.tiles.project(factor.df, factor.width)
            zm = small_vector(products.mean_times_matrix(self.means, factor.df, factor.width), factor.width)
        return self.stored(scores, "scores", self.steps)[0], zm

    def mean_scores(self, factor: Factor) -> np.ndarray:
        """The means times a factor that is a function of the column ids."""
        vectors, width = factor.vectors, factor.width

        def job(batches):
            total = np.zeros((1, width))
            for batch in batches:
                ids = batch.column("col_id").to_numpy(zero_copy_only=False)
                for lo in range(0, len(ids), 4096):
                    value = batch.column("value").slice(lo, 4096).to_numpy(zero_copy_only=False)
                    total += value @ vectors(ids[lo : lo + 4096])
            yield vector_batch(["i"], [np.zeros(1, np.int32)], total)

        sums = self.means.mapInArrow(job, "i int, vec array<double>")
        return small_rows(sum_vectors(sums, ["i"], width), "i", width)[0]

    def kept_means(self) -> DataFrame:
        return self.means

    def take_means(self, means: DataFrame, n_rows: int) -> None:
        """Means are found when a space opens; only the row count can be new."""
        self.n_rows = n_rows

    def absent(self, present: int) -> int:
        if present > self.n_rows:
            raise ValueError(f"n_rows={self.n_rows}, but the matrix holds {present} rows")
        return self.n_rows - present

    def sketch(self, factor: Factor, gram: bool = True, cross: bool = True):
        """(Yc'Zc, Zc'Zc) for Zc = Yc factor, by joins on the column id and then on the row id.

        One scan of the scores brings their number, sum and Gram matrix: those of the scores less their
        mean, with a column of ones.
        """
        scores, zm = self.scores(factor)
        ones = products.shifted(scores, zm).select(F.concat("vec", F.array(F.lit(1.0))).alias("vec"))
        sums = small_rows(products.gram(ones, np.zeros(factor.width + 1)), "i", factor.width + 1)
        absent = self.absent(round(sums[-1, -1]) if len(sums) else 0)
        z_gram = y_cross = None
        if gram:
            z_gram = sums[:-1, :-1] + absent * np.outer(zm, zm)
        if cross:
            excess = sums[-1, :-1] - absent * zm
            table = self.tiles.cross(products.shifted(scores, zm), factor.width)
            table = products.mean_correction(table, self.means, excess)
            y_cross = self.stored_factor(table, factor.width)
        return y_cross, z_gram

    def stack_r(self, factor: Factor, fan_in: int = tsqr.FAN_IN) -> np.ndarray:
        scores, zm = self.scores(factor)
        absent = self.absent(scores.count())
        r = small_rows(tsqr.tsqr_r(scores, zm, fan_in), "i", factor.width)
        return add_absent(r, absent, zm)

    def times(self, factor: Factor, small: np.ndarray) -> Factor:
        """factor @ small, row by row."""
        width = factor.width

        def job(batches):
            for batch in batches:
                keys = batch.column("col_id")
                yield vector_batch(["col_id"], [keys], batch_vectors(batch, width) @ small)

        return Factor(factor.df.mapInArrow(job, FACTOR), small.shape[1], factor.path)

    def joined(self, left: Factor, right: Factor) -> DataFrame:
        return left.df.join(right.df.withColumnRenamed("vec", "other"), "col_id")

    def inner(self, left: Factor, right: Factor) -> np.ndarray:
        """left' right: one small array per task, then a sum."""
        n, m = left.width, right.width

        def job(batches):
            total = np.zeros((n, m))
            for batch in batches:
                total += batch_vectors(batch, n).T @ batch_vectors(batch, m, "other")
            yield vector_batch(["i"], [np.arange(n, dtype=np.int32)], total)

        pairs = self.joined(left, right).select("vec", "other")
        sums = sum_vectors(pairs.mapInArrow(job, "i int, vec array<double>"), ["i"], m)
        return small_rows(sums, "i", m)

    def less(self, factor: Factor, other: Factor, small: np.ndarray) -> Factor:
        """factor - other @ small, row by row."""
        n, m = factor.width, other.width

        def job(batches):
            for batch in batches:
                keys = batch.column("col_id")
                rest = batch_vectors(batch, m, "other") @ small
                yield vector_batch(["col_id"], [keys], batch_vectors(batch, n) - rest)

        table = self.joined(factor, other).mapInArrow(job, FACTOR)
        return self.stored_factor(table, factor.width)

    def signs(self, factor: Factor) -> np.ndarray:
        cells = unpack(factor.df, "col_id")
        size = cells.groupBy("comp").agg(F.max(F.abs("value")).alias("value"))
        least = numbers((1 - TIE) * small_vector(size, factor.width))
        top = cells.where(F.abs("value") >= least[F.col("comp")])
        top = top.groupBy("comp").agg(F.min_by("value", "col_id").alias("value"))
        return np.where(small_vector(top, factor.width) < 0, -1.0, 1.0)

    def svd(self, factor: Factor) -> tuple[Factor, np.ndarray]:
        """Left singular vectors and values, from the R of the factor: its condition is not squared.

        Where the values spread widely, dividing by small ones costs orthogonality; a second round
        restores it.
        """
        u, sigma = self.turned(factor)
        if len(sigma) and sigma[-1] < SPREAD * sigma[0]:
            again, second = self.turned(u, keep_order=True)
            return again, sigma[: len(second)]
        return u, sigma

    def turned(self, factor: Factor, keep_order: bool = False) -> tuple[Factor, np.ndarray]:
        r = small_rows(tsqr.tsqr_r(factor.df, np.zeros(factor.width)), "i", factor.width)
        left, sigma, w = np.linalg.svd(r, full_matrices=False)
        keep = sigma > RANK_TOLERANCE * max(sigma.max(initial=0.0), 0.0)
        turn = w[keep].T / sigma[keep]
        if keep_order:
            # Close to a rotation: turn back, so that each vector stays the one of its value.
            turn = turn @ w[keep]
        u = self.times(factor, turn)
        return self.stored_factor(u.df, u.width), sigma[keep]


class ScanSpace(TableSpace):
    """The factor stays a table, and every task of a scan reads it from the scratch folder.

    A pass is one scan of whole rows. Each task holds the factor and a sum of its size; what is exchanged is
    those sums, and neither cells nor scores. The sums, and all further steps on factors, are tables too.
    """

    def __init__(self, matrix: DataFrame, n_rows: int | None, n_cols: int, width: int = 32):
        self.spark, self.n_cols = matrix.sparkSession, n_cols
        self.base, self.steps = [], []
        if is_rows(matrix) and not has_far_cells(matrix):
            rows = first_segment(matrix)
        else:
            if is_rows(matrix):
                # A row of zeros only has no cells to find it by.
                n_rows = count_rows(matrix) if n_rows is None else n_rows
                matrix = to_entries(matrix)
            rows, _ = self.stored(to_rows(every_row(matrix, n_cols), segment=HELD_COLUMNS), "rows", self.base)
        self.n_rows = rows.count() if n_rows is None else n_rows
        self.cells = narrow_cells(rows, n_cols, 0.0)
        if self.cells is not None:
            means = means_of(narrow_column_sums(self.cells), self.n_rows, n_cols)
        else:
            means = column_means(rows, self.n_rows, n_cols, 0.0)
        self.means, _ = self.stored(means, "means", self.base)
        square = self.means.agg(F.sum(F.col("value") * F.col("value"))).first()[0]
        self.noise = ROUND_OFF * np.sqrt(self.n_rows * square)
        rows = rows.select("indices", "values")
        self.rows = rows.coalesce(min(scan_tasks(planned_bytes(rows), 8 * n_cols * width), (1 << 31) - 1))

    def close(self) -> None:
        self.drop(self.base + self.steps)

    def times(self, factor: Factor, small: np.ndarray) -> Factor:
        turn = small if factor.turn is None else factor.turn @ small
        return replace(super().times(factor, small), vectors=factor.vectors, turn=turn)

    def holding(self, factor: Factor) -> Callable[[], np.ndarray]:
        """What makes the factor as an array inside a task."""
        n_cols, vectors, turn = self.n_cols, factor.vectors, factor.turn
        width, stored_width = factor.width, factor.width if turn is None else len(turn)
        path = None if vectors else full_path(self.spark, factor.path)

        def held() -> np.ndarray:
            out = np.zeros((n_cols, width))
            for ids, some in started(vectors, n_cols) if vectors else stored_vectors(path, stored_width):
                out[ids] = some if turn is None else some @ turn
            return out

        return held

    def mean_scores(self, factor: Factor) -> np.ndarray:
        if not factor.vectors:
            return small_vector(products.mean_times_matrix(self.means, factor.df, factor.width), factor.width)
        width = factor.width if factor.turn is None else len(factor.turn)
        zm = super().mean_scores(replace(factor, width=width))
        return zm if factor.turn is None else zm @ factor.turn

    def sketch(self, factor: Factor, gram: bool = True, cross: bool = True):
        """(Yc'Zc, Zc'Zc) for Zc = Yc factor, in one scan of the rows. The sums of a pass are stored once."""
        width, held, zm = factor.width, self.holding(factor), self.mean_scores(factor)

        def job(batches):
            yield from scan_sums((batch_rows(b, 0.0) for b in batches), held(), zm, cross)

        sums = None
        if self.cells is not None:
            sums = narrow_scan(self.cells, held(), zm, (GRAM, CROSS) if cross else (GRAM,))
        if sums is None:
            sums = sum_vectors(self.rows.mapInArrow(job, PARTIAL), ["part", "i"], width + 1)
        if cross:
            sums, _ = self.stored(sums, "sums", self.steps)
        found = small_rows(sums.where(F.col("part") == GRAM), "i", width + 1)
        absent = self.absent(round(found[-1, -1]) if len(found) else 0)
        z_gram = y_cross = None
        if gram:
            z_gram = found[:-1, :-1] + absent * np.outer(zm, zm)
        if cross:
            table = sums.where(F.col("part") == CROSS).select(F.col("i").alias("col_id"), F.slice("vec", 1, width).alias("vec"))
            table = products.mean_correction(table, self.means, found[-1, :-1] - absent * zm)
            y_cross = self.stored_factor(table, width)
        return y_cross, z_gram

    def stack_r(self, factor: Factor, fan_in: int = tsqr.FAN_IN) -> np.ndarray:
        """R of the QR factorisation of Zc, absent rows included; a column of ones centres it, as in ``LocalSpace``."""
        width, held = factor.width, self.holding(factor)

        def job(batches):
            yield from tsqr.task_r(scores_with_ones((batch_rows(b, 0.0) for b in batches), held()), width + 1, fan_in)

        r = small_rows(tsqr.tree_r(self.rows.mapInArrow(job, tsqr.PARTS), width + 1, fan_in), "i", width + 1)
        absent = self.absent(round(r[0, 0] ** 2) if len(r) else 0)
        return add_absent(r, absent, np.eye(1, width + 1)[0])[1:, 1:]


def every_row(entries: DataFrame, n_cols: int) -> DataFrame:
    """Entries with column ids under ``n_cols``. A row that has cells beyond only is a row all the same."""
    inside = F.col("col_id") < n_cols
    return entries.withColumns(
        {"col_id": F.when(inside, F.col("col_id")).otherwise(0), "value": F.when(inside, F.col("value")).otherwise(0.0)}
    )


def started(vectors: Callable[[np.ndarray], np.ndarray], n_cols: int):
    """(column ids, vectors) of a start, some thousand columns at a time."""
    for lo in range(0, n_cols, 1 << 16):
        ids = np.arange(lo, min(lo + (1 << 16), n_cols))
        yield ids, vectors(ids)


def stored_vectors(path: str, width: int):
    """(column ids, vectors) of a stored factor, batch by batch."""
    system, folder = file_system(path)
    for info in data_files(system, folder):
        with system.open_input_file(info.path) as stream:
            for batch in pq.ParquetFile(stream).iter_batches(columns=["col_id", "vec"]):
                yield batch.column("col_id").to_numpy(zero_copy_only=False), batch_vectors(batch, width)


def scan_sums(blocks, factor: np.ndarray, shift: np.ndarray, cross: bool):
    """Partial sums of a task's blocks: [Z 1]'[Z 1] and, with ``cross``, Y'[Z 1] for Z = Y factor - shift."""
    n_cols, width = factor.shape
    z_gram = np.zeros((width + 1, width + 1))
    y_cross = np.zeros((width + 1, n_cols)) if cross else None
    seen = np.zeros(n_cols, dtype=bool)
    for block in blocks:
        for _, part in block.pieces(n_cols, width):
            z = np.ones((len(part), width + 1))
            z[:, :width] = part.times(factor) - shift
            z_gram += z.T @ z
            if cross:
                part.add_cross(z, y_cross)
                seen[part.index] = True
    yield partial_batch(GRAM, np.arange(width + 1), z_gram)
    columns = np.flatnonzero(seen)
    for some in np.array_split(columns, len(columns) // 4096 + 1):
        yield partial_batch(CROSS, some, y_cross[:, some].T if cross else np.zeros((0, width + 1)))


def scores_with_ones(blocks, factor: np.ndarray):
    """Scores behind a column of ones."""
    for block in blocks:
        for _, part in block.pieces(*factor.shape):
            yield np.hstack([np.ones((len(part), 1)), part.times(factor)])


def partial_batch(part: int, i, vectors: np.ndarray) -> pa.RecordBatch:
    i = np.asarray(i, dtype=np.int32)
    return vector_batch(["part", "i"], [np.full_like(i, part), i], vectors)


def small_rows(packed: DataFrame, key: str, width: int) -> np.ndarray:
    """A table of about ``width`` packed rows as an array, ordered by its key."""
    table = packed.select(key, "vec").toArrow().sort_by(key)
    return np.vstack([np.zeros((0, width)), *(batch_vectors(b, width) for b in table.to_batches())])


def small_vector(long: DataFrame, width: int) -> np.ndarray:
    """A (comp, value) table of ``width`` rows as an array."""
    table = long.select("comp", "value").toArrow()
    out = np.zeros(width)
    out[table["comp"].to_numpy()] = table["value"].to_numpy()
    return out


def add_absent(r: np.ndarray, absent: int, row: np.ndarray) -> np.ndarray:
    """Fold the rows without a stored cell, all alike, into R: together they weigh sqrt(absent)."""
    return tsqr.fold_r(r, np.sqrt(absent) * row[None, :])
