"""A stored two-way layout of a matrix: tiles of a column block by a group of rows, in a bucketed table.

A tile holds the cells of one block of columns in the rows of one hash group. Tiles are written once,
bucketed by their number, and every later product meets them bucket by bucket: a task reads the tile where it
is stored and receives only the part of the factor, or of the scores, that belongs to it. So a pass
exchanges factors and scores and never a cell. A block is small enough for an array in a task, and a block
with many cells has many row groups, so neither a popular column nor a long row makes a hot tile.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import sum_vectors
from ..operators.blocks import SparseBlock, batch_vectors
from ..session import drop_path, scratch_path

# The factor of a block, as an array of the sketch's width; the cells of a tile; the scores a tile may touch.
BLOCK_BYTES = 8 << 20
TILE_CELLS = 1 << 20
TILE_SCORE_BYTES = 128 << 20
CHUNK_CELLS = 1 << 16
# Spark's own bound on buckets is 100,000; a bucket may hold several tiles.
MOST_BUCKETS = 50_000

CHUNKS = "tile long, block int, rows array<long>, lengths array<int>, index array<int>, value array<double>"
PARTIAL_SCORES = "row_id long, block int, vec array<double>"
CHUNK_TYPES = pa.schema([
    ("tile", pa.int64()),
    ("block", pa.int32()),
    ("rows", pa.list_(pa.int64())),
    ("lengths", pa.list_(pa.int32())),
    ("index", pa.list_(pa.int32())),
    ("value", pa.list_(pa.float64())),
])


def block_columns(width: int) -> int:
    return max(1, BLOCK_BYTES // (8 * width))


def tile_cells(total: int, width: int, partitions: int) -> int:
    """Cells of a tile: bounded by what a task holds, and few enough that every shuffle partition has one."""
    return max(1, min(TILE_CELLS, TILE_SCORE_BYTES // (8 * width), -(-total // partitions)))


def _chunks(key: tuple, table: pa.Table) -> pa.Table:
    """One tile's cells as sparse rows, in pieces of bounded size."""
    order = np.lexsort((table["index"].to_numpy(), table["row_id"].to_numpy()))
    row, index = table["row_id"].to_numpy()[order], table["index"].to_numpy()[order]
    value, block = table["value"].to_numpy()[order], table["block"][0].as_py()
    out = []
    for lo in range(0, len(row), CHUNK_CELLS):
        part = slice(lo, lo + CHUNK_CELLS)
        rows, lengths = np.unique(row[part], return_counts=True)
        arrays = (rows, lengths.astype(np.int32), index[part], value[part])
        out.append((key[0].as_py(), block, *arrays))
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), CHUNK_TYPES)], schema=CHUNK_TYPES)


def _numbers(column: pa.ChunkedArray, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


def _blocks(table: pa.Table):
    """(row ids, sparse block) of every chunk of a tile."""
    for k in range(table.num_rows):
        lengths, index, value = (_numbers(table[c], k) for c in ("lengths", "index", "value"))
        yield _numbers(table["rows"], k), SparseBlock(lengths, index.astype(np.int64), value)


def _vectors(table: pa.Table, width: int) -> np.ndarray:
    return np.vstack([np.zeros((0, width)), *(batch_vectors(b, width) for b in table.to_batches())])


def _packed(names: list[str], keys: list[pa.Array], vectors: np.ndarray) -> pa.Table:
    n, width = vectors.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    vec = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(vectors).ravel()))
    return pa.table([*keys, vec], names=[*names, "vec"])


@dataclass(frozen=True)
class Tiles:
    """The stored tiles, with the row groups of each block and the names to delete them by."""

    table: DataFrame
    groups: DataFrame
    columns: int
    blocks: int
    name: str
    path: str

    @classmethod
    def store(cls, cells: DataFrame, width: int, columns: int | None = None) -> Tiles:
        """Write (row_id, col_id, value) cells, each of them once, as tiles for sketches of this width.

        ``columns`` sets how many make a block; by default as many as BLOCK_BYTES hold.
        """
        spark, columns = cells.sparkSession, columns or block_columns(width)
        cells = cells.withColumn("block", F.expr(f"CAST(col_id DIV {columns} AS INT)"))
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # One row for each block of columns: 2^31 columns of a sketch of 100 are some 200,000.
        counted = cells.groupBy("block").count().orderBy("block").collect()
        most = tile_cells(sum(r["count"] for r in counted), width, partitions)
        groups, first = [], 0
        for r in counted:
            n = -(-r["count"] // most)
            groups.append((r["block"], first, n))
            first += n
        groups = spark.createDataFrame(groups, "block int, first long, n_groups int")
        buckets = min(MOST_BUCKETS, max(first, partitions))
        placed = cells.join(F.broadcast(groups), "block").select(
            cls.tile_of("row_id").alias("tile"),
            "block",
            F.col("row_id").cast("long"),
            (F.col("col_id") - F.col("block") * columns).cast("int").alias("index"),
            F.col("value").cast("double"),
        )
        # A key of the exchange that equals the bucketing: each task then writes the file of one bucket.
        chunks = placed.repartition(buckets, "tile").groupBy("tile").applyInArrow(_chunks, CHUNKS)
        name, path = f"eigenloom_{uuid.uuid4().hex}", scratch_path(spark, "tiles")
        chunks.write.format("parquet").bucketBy(buckets, "tile").option("path", path).saveAsTable(name)
        blocks = max((r["block"] for r in counted), default=0) + 1
        return cls(spark.table(name), groups, columns, blocks, name, path)

    @staticmethod
    def tile_of(row: str):
        return F.col("first") + F.pmod(F.xxhash64(F.col(row).cast("long")), F.col("n_groups").cast("long"))

    def drop(self) -> None:
        spark = self.table.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_path(spark, self.path)

    def cells(self) -> DataFrame:
        """(col_id, value) of every cell."""
        pairs = self.table.select("block", F.explode(F.arrays_zip("index", "value")).alias("x"))
        return pairs.select((F.col("block") * self.columns + F.col("x.index")).cast("int").alias("col_id"), "x.value")

    def meet(self, other: DataFrame, job, schema: str) -> DataFrame:
        """``job(tile's chunks, its rows of other)`` for every tile; only ``other`` is exchanged."""
        return self.table.groupBy("tile").cogroup(other.groupBy("tile")).applyInArrow(job, schema)

    def project(self, factor: DataFrame, width: int) -> DataFrame:
        """Scores (row_id, vec, blocks): each row's products with a packed factor, and the blocks it touches."""
        columns, scores = self.columns, self._scores(width)
        block = F.expr(f"CAST(col_id DIV {columns} AS INT)")
        copies = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_groups") - 1)).alias("tile")
        sent = factor.withColumn("block", block).join(F.broadcast(self.groups), "block").select(
            copies, (F.col("col_id") - F.col("block") * columns).alias("index"), "vec"
        )

        def job(tile: pa.Table, part: pa.Table) -> pa.Table:
            held = np.zeros((columns, width))
            held[part["index"].to_numpy()] = _vectors(part, width)
            return scores(tile, held)

        return self._whole_rows(self.meet(sent, job, PARTIAL_SCORES), width)

    def project_seed(self, vectors, width: int) -> DataFrame:
        """The same for a factor that is a function of the column ids: nothing is sent to the tiles."""
        columns, scores = self.columns, self._scores(width)

        def job(key: tuple, tile: pa.Table) -> pa.Table:
            present = np.unique(np.concatenate([_numbers(tile["index"], k) for k in range(tile.num_rows)]))
            held = np.zeros((columns, width))
            held[present] = vectors(present.astype(np.int64) + tile["block"][0].as_py() * columns)
            return scores(tile, held)

        return self._whole_rows(self.table.groupBy("tile").applyInArrow(job, PARTIAL_SCORES), width)

    def _scores(self, width: int):
        """(row_id, block, vec) of one tile, against its block's part of the factor."""
        columns = self.columns

        def scores(tile: pa.Table, held: np.ndarray) -> pa.Table:
            ids, sums = [np.zeros(0, np.int64)], [np.zeros((0, width))]
            for rows, chunk in _blocks(tile):
                ids.append(rows)
                sums += [piece.times(held) for _, piece in chunk.pieces(columns, width)]
            ids, sums = np.concatenate(ids), np.vstack(sums)
            # A row may go on in the next chunk.
            new = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])[: len(ids)])
            if len(new) < len(ids):
                ids, sums = ids[new], np.add.reduceat(sums, new, axis=0)
            block = tile["block"][0].as_py() if tile.num_rows else 0
            return _packed(["row_id", "block"], [pa.array(ids), pa.array(np.full(len(ids), block, np.int32))], sums)

        return scores

    def _whole_rows(self, partial: DataFrame, width: int) -> DataFrame:
        """Scores of the tiles of a row added up, with the blocks they came from."""
        if self.blocks == 1:
            # A tile holds its rows whole.
            return partial.select("row_id", "vec", F.array("block").alias("blocks"))
        cells = [F.expr(f"sum(vec[{j}]) AS c{j}") for j in range(width)]
        if self.blocks < 64:
            touched = F.bit_or(F.expr("shiftleft(1L, block)")).alias("mask")
            blocks = F.expr(f"filter(sequence(0, {self.blocks - 1}), b -> getbit(mask, b) = 1)")
        else:
            touched, blocks = F.collect_set("block").alias("touched"), F.col("touched")
        vec = F.expr("array(" + ", ".join(f"c{j}" for j in range(width)) + ")")
        summed = partial.groupBy("row_id").agg(*cells, touched)
        return summed.select("row_id", vec.alias("vec"), blocks.alias("blocks"))

    def cross(self, scores: DataFrame, width: int) -> DataFrame:
        """Y'Z as (col_id, vec), for scores (row_id, vec, blocks); rows go to the tiles that hold them."""
        columns = self.columns
        sent = scores.select("row_id", "vec", F.explode("blocks").alias("block")).join(F.broadcast(self.groups), "block")
        sent = sent.select(self.tile_of("row_id").alias("tile"), "row_id", "vec")

        def job(tile: pa.Table, part: pa.Table) -> pa.Table:
            ids = part["row_id"].to_numpy()
            order = np.argsort(ids)
            ids, z = ids[order], _vectors(part, width)[order]
            sums, seen = np.zeros((width, columns)), np.zeros(columns, bool)
            for rows, chunk in _blocks(tile):
                at = np.searchsorted(ids, rows)
                for first, piece in chunk.pieces(columns, width):
                    piece.add_cross(z[at[first : first + len(piece)]], sums)
                    seen[piece.index] = True
            touched = np.flatnonzero(seen)
            base = tile["block"][0].as_py() * columns if tile.num_rows else 0
            return _packed(["col_id"], [pa.array((touched + base).astype(np.int32))], sums[:, touched].T)

        return sum_vectors(self.meet(sent, job, "col_id int, vec array<double>"), ["col_id"], width)
