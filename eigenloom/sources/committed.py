"""Lines with their row ids in committed folders: a Spark data source to write and read them.

A folder holds data files below ``data-<write>/`` and ``manifest-<version>.json``; the manifest of the highest
version names the files of the table in row order, and nothing else in the folder counts. For each file it has
the first and the last row id and marks ``[byte, line, runs, row id]`` from which a task can begin. Where the ids
of a file have gaps or repeats, ``<file>.runs`` beside it lists (line, row id), two little-endian signed 64-bit
integers for each run of ids that follow one another; ``runs`` of a mark counts the runs begun before it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from .files import SPLIT_BYTES, file_system, line_blocks

FORMAT = "committed_lines"
SCHEMA = "row_id long, line string"
MANIFEST = re.compile(r"manifest-(\d{8,})\.json")
DATA = re.compile(r"data-[0-9a-f]{32}")
MODES = ("errorifexists", "overwrite", "append")


@dataclass
class Part(WriterCommitMessage):
    part: int
    name: str = ""
    first: int = 0
    last: int = 0
    lines: int = 0
    bytes: int = 0
    runs: int = 0
    marks: list[list[int]] = field(default_factory=list)


@dataclass
class LineRange(InputPartition):
    name: str
    lo: int
    hi: int
    line: int
    runs: tuple[int, int]
    first: int


def versions(system: fs.FileSystem, path: str) -> dict[int, str]:
    """Manifests of a folder by version."""
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    named = ((MANIFEST.fullmatch(info.base_name), info.path) for info in found)
    return {int(match[1]): path for match, path in named if match}


def _loaded(system: fs.FileSystem, path: str) -> list[dict]:
    with system.open_input_stream(path) as stream:
        return json.loads(stream.read())["files"]


class CommittedLines(DataSource):
    """``committed_lines``: rows (row_id, line), in the order of the partitions written and the rows in them.

    Row ids must not fall in that order. Tasks write files of names of their own; the driver names those of
    finished tasks in a new manifest, by one move, after all are done. A write that fails or is lost before
    leaves the table as it was. Options: ``path``, ``split_bytes`` (bytes between marks).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return LinesWriter(self.options, overwrite, schema.names)


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool, names: list[str]):
        self.path, self.overwrite = options["path"], overwrite
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.folder = f"data-{uuid.uuid4().hex}"
        self.at = names.index("row_id"), names.index("line")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, path = file_system(self.path)
        done = Part(TaskContext.get().partitionId())
        stream = runs = None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                ids, lines = batch.column(self.at[0]), batch.column(self.at[1])
                if ids.null_count or lines.null_count:
                    raise ValueError("a row id or a line is null")
                if pc.any(pc.match_substring(lines, "\n")).as_py():
                    raise ValueError("a line holds a line break")
                ids = ids.cast(pa.int64()).to_numpy()
                if stream is None:
                    done.name, done.first = f"{self.folder}/{uuid.uuid4().hex}.txt", int(ids[0])
                    system.create_dir(f"{path}/{self.folder}", recursive=True)
                    stream = system.open_output_stream(f"{path}/{done.name}")
                    before = ids[0] - 1
                else:
                    before = done.last
                steps = np.diff(ids, prepend=before)
                if steps.min() < 0:
                    raise ValueError("row ids fall: sort the rows by them before they are written")
                begun = np.flatnonzero(steps != 1)
                if len(begun) and runs is None:
                    runs = system.open_output_stream(f"{path}/{done.name}.runs")
                    runs.write(np.array([0, done.first], "<i8").tobytes())
                    done.runs = 1
                if len(begun):
                    runs.write(np.stack((begun + done.lines, ids[begun]), axis=1).astype("<i8").tobytes())
                sizes = pc.binary_length(lines).to_numpy().astype(np.int64) + 1
                self._mark(done, sizes, ids, begun)
                stream.write("".join(f"{line}\n" for line in lines.to_pylist()).encode())
                done.runs += len(begun)
                done.lines += len(ids)
                done.bytes += int(sizes.sum())
                done.last = int(ids[-1])
        finally:
            for each in (stream, runs):
                if each is not None:
                    each.close()
        return done

    def _mark(self, done: Part, sizes: np.ndarray, ids: np.ndarray, begun: np.ndarray) -> None:
        """Marks at the first line and at the next one after each ``split_bytes``."""
        at = done.bytes + np.cumsum(sizes) - sizes
        wanted = done.marks[-1][0] + self.split_bytes if done.marks else 0
        while (k := int(np.searchsorted(at, wanted))) < len(at):
            runs = done.runs + int(np.searchsorted(begun, k))
            done.marks.append([int(at[k]), done.lines + k, runs, int(ids[k])])
            wanted = int(at[k]) + self.split_bytes

    def commit(self, messages: list[Part | None]) -> None:
        system, path = file_system(self.path)
        known = versions(system, path)
        latest = max(known, default=0)
        files = [] if self.overwrite or not known else _loaded(system, known[latest])
        for part in sorted((m for m in messages if m and m.lines), key=lambda m: m.part):
            if files and part.first < files[-1]["last"]:
                raise ValueError(f"row ids fall between files: {files[-1]['last']}, then {part.first}")
            files.append(asdict(part))
        system.create_dir(path, recursive=True)
        target = f"{path}/manifest-{latest + 1:08d}.json"
        with system.open_output_stream(f"{target}.new") as stream:
            stream.write(json.dumps({"files": files}).encode())
        system.move(f"{target}.new", target)
        self._forget(system, path, known, latest, files)

    def _forget(self, system: fs.FileSystem, path: str, known: dict[int, str], latest: int, files: list[dict]) -> None:
        """Delete what neither this table nor the one before names: a reader of that one can go on.

        Tasks that were killed may leave files after their write was given up, so all data folders count.
        """
        needed = {f["name"].split("/")[0] for f in [*files, *(_loaded(system, known[latest]) if known else [])]}
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.type == fs.FileType.Directory and DATA.fullmatch(info.base_name) and info.base_name not in needed:
                system.delete_dir(info.path)
        for version in known:
            if version < latest:
                system.delete_file(known[version])

    def abort(self, messages: list[Part | None]) -> None:
        system, path = file_system(self.path)
        if system.get_file_info(f"{path}/{self.folder}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.folder}")


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.least, self.most = -(1 << 63), (1 << 63) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of row_id leave out files and stretches; Spark still looks at the rows of the others."""
        for f in filters:
            if getattr(f, "attribute", None) == ("row_id",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.least = max(self.least, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.most = min(self.most, f.value)
            yield f

    def partitions(self) -> list[LineRange]:
        system, path = file_system(self.path)
        known = versions(system, path)
        if not known:
            raise FileNotFoundError(f"no committed lines in {self.path}")
        found = []
        for file in _loaded(system, known[max(known)]):
            end = [file["bytes"], file["lines"], file["runs"], file["last"]]
            for (lo, line, runs, first), (hi, _, next_runs, last) in zip(file["marks"], [*file["marks"][1:], end]):
                if first <= self.most and last >= self.least:
                    found.append(LineRange(file["name"], lo, hi, line, (max(runs - 1, 0), next_runs), first))
        return found or [LineRange("", 0, 0, 0, (0, 0), 0)]

    def read(self, partition: LineRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, path = file_system(self.path)
        lo, hi = partition.runs
        starts, ids = np.array([partition.line]), np.array([partition.first])
        if hi:
            with system.open_input_file(f"{path}/{partition.name}.runs") as stream:
                raw = np.frombuffer(stream.read_at(16 * (hi - lo), 16 * lo), "<i8").reshape(-1, 2)
            starts, ids = raw[:, 0], raw[:, 1]
        line = partition.line
        with system.open_input_file(f"{path}/{partition.name}") as stream:
            for block in line_blocks(stream, partition.lo, partition.hi):
                lines = pc.split_pattern(pa.array([block[:-1].decode()], pa.string()), "\n").values
                numbers = np.arange(line, line + len(lines))
                run = np.searchsorted(starts, numbers, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[run] + numbers - starts[run]), lines], names=["row_id", "line"])
                line += len(lines)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(CommittedLines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_committed_lines(lines: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    """Rows (row_id, line), sorted by row_id already, as the new content of a committed folder.

    ``append`` adds rows whose ids do not lie below those there. ``overwrite`` keeps the files of the last
    content until the next write, for readers that began before. One write at a time.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = _registered(lines.sparkSession)
    if mode == "errorifexists" and versions(*file_system(path)):
        raise FileExistsError(f"{path} holds committed lines")
    lines = lines.select(F.col("row_id").cast("long").alias("row_id"), F.col("line").cast("string").alias("line"))
    mode = "append" if mode == "errorifexists" else mode
    lines.write.format(FORMAT).mode(mode).options(**options).save(path)


def read_committed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, line) of a committed folder: ids as written, without counting or sorting."""
    return _registered(spark).read.format(FORMAT).load(path)
