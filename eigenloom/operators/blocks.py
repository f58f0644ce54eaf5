"""Arrow batches of sparse rows as small numpy blocks, for use inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Numbers in the largest temporary array of a task, apart from those of a single long row.
CHUNK_NUMBERS = 1 << 22

# Fill above which a block is multiplied as a dense array, and the largest such array (in cells).
DENSE_FILL = 0.02
DENSE_CELLS = 1 << 21


class SparseBlock:
    """Consecutive sparse rows: lengths per row, then column ids and values end to end."""

    def __init__(self, lengths: np.ndarray, index: np.ndarray, value: np.ndarray):
        self.lengths, self.index, self.value = lengths, index, value

    def __len__(self) -> int:
        return len(self.lengths)

    def chunks(
        self, max_rows: int | None = None, max_cells: int = CHUNK_NUMBERS
    ) -> Iterator[tuple[int, SparseBlock]]:
        """(first row, block) pieces of at most ``max_cells`` cells, or one row, and ``max_rows`` rows."""
        ends = np.cumsum(self.lengths)
        row, n = 0, len(self)
        while row < n:
            begin = ends[row - 1] if row else 0
            last = int(np.searchsorted(ends, begin + max_cells, side="right"))
            last = max(last, row + 1)
            if max_rows:
                last = min(last, row + max_rows)
            last = min(last, n)
            cells = slice(begin, ends[last - 1])
            yield row, SparseBlock(self.lengths[row:last], self.index[cells], self.value[cells])
            row = last

    def pieces(self, n_cols: int, width: int = 1) -> Iterator[tuple[int, SparseBlock]]:
        """Chunks with column ids under ``n_cols``, sized for products with ``width`` components.

        Well filled ones are cut to a bounded dense size.
        """
        for start, chunk in self.chunks(max_cells=CHUNK_NUMBERS // width):
            chunk = chunk.below(n_cols)
            if chunk.is_dense(n_cols):
                for offset, part in chunk.chunks(max(1, DENSE_CELLS // max(n_cols, 1))):
                    yield start + offset, part
            else:
                yield start, chunk

    def below(self, n_cols: int) -> SparseBlock:
        """Only the cells with a column id under ``n_cols``."""
        if not len(self.index) or self.index.max() < n_cols:
            return self
        keep = self.index < n_cols
        lengths = np.bincount(self.row_of()[keep], minlength=len(self))
        return SparseBlock(lengths, self.index[keep], self.value[keep])

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.lengths)

    def dense(self, n_cols: int) -> np.ndarray:
        shape = (len(self), n_cols)
        if len(self.index) == shape[0] * n_cols and (self.lengths == n_cols).all():
            if (self.index.reshape(shape) == np.arange(n_cols)).all():
                return self.value.reshape(shape)
        flat = self.row_of() * n_cols + self.index
        return np.bincount(flat, weights=self.value, minlength=shape[0] * n_cols).reshape(shape)

    def is_dense(self, n_cols: int) -> bool:
        return len(self.index) >= DENSE_FILL * len(self) * n_cols

    def times(self, factor: np.ndarray) -> np.ndarray:
        """block @ factor, for a factor of shape (n_cols, width)."""
        if self.is_dense(len(factor)):
            return self.dense(len(factor)) @ factor
        out = np.zeros((len(self), factor.shape[1]))
        starts = np.cumsum(self.lengths) - self.lengths
        # Rows of equal length form one batched product; a chunk has few distinct lengths.
        order = np.argsort(self.lengths, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(self.lengths[order])) + 1):
            length = self.lengths[rows[0]] if len(rows) else 0
            if not length:
                continue
            cells = starts[rows][:, None] + np.arange(length)
            picked = factor.take(self.index[cells], axis=0)
            out[rows] = np.matmul(self.value[cells][:, None, :], picked)[:, 0, :]
        return out

    def add_cross(self, scores: np.ndarray, into: np.ndarray) -> None:
        """into += (block' @ scores)', for a sum stored as (width, n_cols)."""
        n_cols = into.shape[1]
        if self.is_dense(n_cols):
            into += scores.T @ self.dense(n_cols)
            return
        row, columns, place = self.row_of(), slice(None), self.index
        if len(self.index) < n_cols:
            columns, place = np.unique(self.index, return_inverse=True)
            n_cols = len(columns)
        for j in range(len(into)):
            weights = self.value * scores[:, j].take(row)
            into[j, columns] += np.bincount(place, weights=weights, minlength=n_cols)


def batch_rows(batch, null: float | None = None) -> SparseBlock:
    """The ``indices`` and ``values`` columns of an Arrow batch as one block; ``null`` stands for null values."""
    index, value = batch.column("indices"), batch.column("values")
    lengths = index.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    value = value.flatten() if null is None else value.flatten().fill_null(null)
    return SparseBlock(
        lengths,
        index.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
        value.to_numpy(zero_copy_only=False),
    )


def batch_vectors(batch, width: int, name: str = "vec") -> np.ndarray:
    """A packed vector column of an Arrow batch as an (n, width) array."""
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)
