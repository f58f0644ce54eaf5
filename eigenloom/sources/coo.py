"""Coordinate text as a Spark data source with its own splits, and filters on ids applied while reading."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from .files import SPLIT_BYTES, data_files, file_system, line_blocks

FORMAT = "coo_text"
NAMES = ["row_id", "col_id", "value"]
KINDS = [pa.int64(), pa.int32(), pa.float64()]
SCHEMA = "row_id long, col_id int, value double"
# What opening a file costs, in bytes read: small files share a task up to that.
OPEN_BYTES = 4 << 20
COMPARE = {LessThan: "less", LessThanOrEqual: "less_equal", GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", EqualTo: "equal"}
NUMBER = r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|nan|inf(?:inity)?)"
TRIPLE = re.compile(rf"\s*([+-]?[0-9]+)\s*,\s*([+-]?[0-9]+)\s*,\s*({NUMBER})\s*", re.IGNORECASE | re.ASCII)


@dataclass
class ByteRanges(InputPartition):
    ranges: list[tuple[str, int, int]]


def cells_of(block: bytes, drop: bool) -> pa.RecordBatch:
    """The triples of some whole lines. Blocks with a line that is no plain triple are read line by line."""
    try:
        table = csv.read_csv(
            pa.BufferReader(block),
            csv.ReadOptions(use_threads=False, block_size=len(block) + 1, column_names=NAMES),
            csv.ParseOptions(quote_char=False),
            csv.ConvertOptions(column_types=dict(zip(NAMES, KINDS)), null_values=[], check_utf8=False),
        )
        return table.combine_chunks().to_batches()[0] if len(table) else _batch([])
    except pa.ArrowInvalid:
        return _batch(list(_line_by_line(block, drop)))


def _batch(cells: list[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = zip(*cells) if cells else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], names=NAMES)


def _line_by_line(block: bytes, drop: bool) -> Iterator[tuple[int, int, float]]:
    for line in block.decode("utf-8", "replace").split("\n"):
        if not line.strip():
            continue
        triple = TRIPLE.fullmatch(line)
        if triple:
            row, col = int(triple[1]), int(triple[2])
            if -(1 << 63) <= row < 1 << 63 and -(1 << 31) <= col < 1 << 31:
                yield row, col, float(triple[3])
                continue
        if not drop:
            raise ValueError(f"not row,col,value: {line[:200]!r}")


class CooText(DataSource):
    """``coo_text``: lines ``row,col,value`` as (row_id, col_id, value), repeated cells as they are.

    Options: ``path`` (a file or a folder), ``base`` (subtracted from column ids), ``malformed`` (``fail`` or
    ``drop``), ``split_bytes``. Files are cut into ranges of bytes, small ones share a task. Comparisons of
    row_id and col_id with a number are applied inside the task, before rows go to Spark. Blank lines and
    blanks around numbers do not count; quotes are not numbers.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CooReader(self.options)


class CooReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.base = options["path"], int(options.get("base", 0))
        self.malformed = options.get("malformed", "fail")
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        if self.malformed not in ("fail", "drop") or self.split_bytes < 1:
            raise ValueError("malformed must be 'fail' or 'drop', split_bytes at least 1")
        self.tests: list[tuple[str, str, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, IsNotNull) and column in NAMES:
                continue
            if type(f) in COMPARE and column in NAMES[:2] and isinstance(f.value, int):
                self.tests.append((column, COMPARE[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[ByteRanges]:
        system, path = file_system(self.path)
        tasks, open_, cost = [], [], 0
        for info in data_files(system, path):
            for lo in range(0, info.size, self.split_bytes):
                hi = min(lo + self.split_bytes, info.size)
                if open_ and cost + hi - lo > self.split_bytes:
                    tasks.append(ByteRanges(open_))
                    open_, cost = [], 0
                open_.append((info.path, lo, hi))
                cost += hi - lo + OPEN_BYTES
        return [*tasks, ByteRanges(open_)]

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        for path, lo, hi in partition.ranges:
            with system.open_input_file(path) as stream:
                for block in line_blocks(stream, lo, hi):
                    batch = self._wanted(cells_of(block, self.malformed == "drop"))
                    if batch.num_rows:
                        yield batch

    def _wanted(self, cells: pa.RecordBatch) -> pa.RecordBatch:
        cols = cells.column(1).to_numpy().astype(np.int64) - self.base
        if len(cols) and cols.min() < 0:
            raise ValueError(f"column id below the base: {cols.min() + self.base}")
        cells = pa.RecordBatch.from_arrays([cells.column(0), pa.array(cols).cast(pa.int32()), cells.column(2)], names=NAMES)
        for column, test, value in self.tests:
            cells = cells.filter(pc.call_function(test, [cells.column(column), pa.scalar(value, pa.int64())]))
        return cells


def scan_coo_text(spark: SparkSession, path: str, base: int = 0, malformed: str = "fail", **options) -> DataFrame:
    """Entries of coordinate text through the data source ``coo_text``, cells unmerged; see ``CooText``."""
    spark.dataSource.register(CooText)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(FORMAT).option("base", base).option("malformed", malformed)
    return reader.options(**options).load(path)
