"""Token ids as files of fixed-width bits, a Spark data source to write and read them (operator 12).

A file holds, in this order: MAGIC; a header of eight little-endian unsigned 64-bit integers (version, bits
of an id, ids in a block, ids, blocks, documents, and where the block offsets and the document index begin);
the blocks; the byte offset of each block, unsigned 64 bit; the document index, an Arrow stream of
(doc_id, start). Ids lie one after another, lowest bit first, in the fewest bits that the vocabulary needs.
A block begins on a byte, so any id's block is read and unpacked by itself. ``manifest.json`` lists the files
in the order of their ids with the ids before each; a folder without it was not committed.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type
from pyspark.sql.types import BinaryType, LongType, StructType

from .pretokens import encoder, tokenizer_size
from .texts import slices, utf8

MAGIC = b"PACKIDS\0"
HEADER = len(MAGIC) + 64
VERSION = 1
BLOCK_IDS = 4096
FILE_IDS = 64 << 20
SPLIT_IDS = 4 << 20
BATCH_IDS = 1 << 20
END_ID = 2
FORMAT = "packed_ids"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest first; the last byte is filled with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if bits in (8, 16, 32):
        return raw[: n * bits // 8].view(f"<u{bits // 8}").astype(np.uint32)
    first = np.arange(n, dtype=np.int64) * bits
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word |= padded[(first >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (first & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, of a URI or of a plain path."""
    if "://" in path or path.startswith("file:"):
        system, path = fs.FileSystem.from_uri(path)
        return system, path.rstrip("/")
    return fs.LocalFileSystem(), path.rstrip("/")


class PackedWriter:
    """One file being written: blocks go out as they fill, the index is kept until the end."""

    def __init__(self, stream, bits: int, block_ids: int, id_kind: pa.DataType):
        self.stream, self.bits, self.block_ids, self.id_kind = stream, bits, block_ids, id_kind
        self.rest, self.n_ids, self.starts, self.doc_ids = np.zeros(0, np.uint32), 0, [], []
        self.at, self.offsets = HEADER, []
        stream.write(b"\0" * HEADER)

    def add(self, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        ends = np.cumsum(lengths)
        self.starts.append(self.n_ids + ends - lengths)
        self.doc_ids.append(doc_ids)
        self.n_ids += len(ids)
        ids = np.concatenate((self.rest, ids))
        whole = len(ids) // self.block_ids * self.block_ids
        self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        """Blocks of eight whole ids or a multiple end on a byte, so many are packed at once."""
        if len(ids):
            raw = pack(ids, self.bits)
            size = self.block_ids * self.bits // 8
            self.offsets += range(self.at, self.at + len(raw), size)
            self.stream.write(raw)
            self.at += len(raw)

    def header(self) -> bytes:
        """Write what is left, the offsets and the index. Returns the header, to be put at the front."""
        self._blocks(self.rest)
        self.stream.write(np.array(self.offsets, "<u8").tobytes())
        index = pa.table({
            "doc_id": pa.chunked_array(self.doc_ids, self.id_kind),
            "start": pa.array(np.concatenate(self.starts), pa.int64()),
        })
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as out:
            out.write_table(index)
        self.stream.write(sink.getvalue())
        fields = [VERSION, self.bits, self.block_ids, self.n_ids, len(self.offsets), len(index), self.at]
        return MAGIC + np.array([*fields, self.at + 8 * len(self.offsets)], "<u8").tobytes()


class PackedFile:
    """Random access to one file: any run of ids, and any document, by reading the blocks they lie in."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.stream = system.open_input_file(path)
        head = self.stream.read_at(HEADER, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is not a file of packed ids")
        fields = np.frombuffer(head, "<u8", offset=len(MAGIC)).tolist()
        version, self.bits, self.block_ids, self.n_ids, blocks, self.n_docs, offsets_at, index_at = fields
        if version != VERSION:
            raise ValueError(f"{path} has version {version}")
        raw = self.stream.read_at(8 * blocks, offsets_at)
        self.offsets = np.append(np.frombuffer(raw, "<u8").astype(np.int64), offsets_at)
        index = pa.ipc.open_stream(self.stream.read_at(self.stream.size() - index_at, index_at)).read_all()
        self.doc_ids = index["doc_id"].combine_chunks()
        self.starts = np.append(index["start"].to_numpy(), self.n_ids)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo .. hi - 1 of the file."""
        if lo < 0 or hi > self.n_ids:
            raise IndexError(f"ids {lo} to {hi} of {self.n_ids}")
        if lo >= hi:
            return np.zeros(0, np.uint32)
        a, b = lo // self.block_ids, (hi - 1) // self.block_ids + 1
        begin, end = int(self.offsets[a]), int(self.offsets[b])
        raw = np.frombuffer(self.stream.read_at(end - begin, begin), np.uint8)
        found = unpack(raw, self.bits, min(b * self.block_ids, self.n_ids) - a * self.block_ids)
        return found[lo - a * self.block_ids : hi - a * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.stream.close()


@dataclass
class FilePart(WriterCommitMessage):
    part: int
    name: str
    n_ids: int
    n_docs: int


@dataclass
class DocumentRange(InputPartition):
    name: str
    before: int
    lo: int
    hi: int


class PackedIds(DataSource):
    """``packed_ids``: rows (doc_id, start, n_tokens, ids), ids as little-endian unsigned 32-bit integers.

    Rows to write are (doc_id, ids), or (doc_id, text) with the options ``tokenizer`` (a file) and ``end_id``.
    Writing keeps the order of the partitions and of the rows in them; ``start`` and ``n_tokens`` follow
    from the ids. Further options: ``bits`` (of an id), ``block_ids`` (a multiple of 8). A task writes a
    file under a name of its own and the driver names the files of finished tasks in the manifest, so
    attempts that were lost or ran twice are not seen by readers.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        system, path = file_system(self.options["path"])
        kind = LongType()
        for entry in read_manifest(system, path)["files"][:1]:
            file = PackedFile(system, f"{path}/{entry['name']}")
            kind = from_arrow_type(file.doc_ids.type)
            file.close()
        return StructType().add("doc_id", kind).add("start", LongType()).add("n_tokens", LongType()).add("ids", BinaryType())

    def reader(self, schema: StructType) -> DataSourceReader:
        return PackedIdsReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PackedIdsWriter(self.options, to_arrow_type(schema["doc_id"].dataType), schema.names)


def read_manifest(system: fs.FileSystem, path: str) -> dict:
    with system.open_input_stream(f"{path}/manifest.json") as stream:
        return json.loads(stream.read())


class PackedIdsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, id_kind: pa.DataType, names: list[str]):
        self.path, self.bits = options["path"], int(options["bits"])
        self.block_ids = int(options.get("block_ids", BLOCK_IDS))
        if self.block_ids % 8 or not 1 <= self.bits <= 32:
            raise ValueError("block_ids must be a multiple of 8, bits 1 to 32")
        self.id_kind, self.id_at = id_kind, names.index("doc_id")
        self.tokenizer, self.end_id = options.get("tokenizer"), int(options.get("end_id", END_ID))
        self.at = names.index("text" if self.tokenizer else "ids")

    def _documents(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(doc_ids, lengths, ids) of a batch, some MB of text at a time."""
        doc_ids = batch.column(self.id_at).cast(self.id_kind)
        data, offsets = utf8(batch.column(self.at))
        if not self.tokenizer:
            yield doc_ids, np.diff(offsets) // 4, np.frombuffer(data.tobytes(), "<u4")
            return
        encode = encoder(self.tokenizer).encode
        for lo, hi in slices(offsets, 2 << 20):
            texts = batch.column(self.at).slice(lo, hi - lo).to_pylist()
            ids, begin = encode([t or "" for t in texts], self.end_id)
            yield doc_ids.slice(lo, hi - lo), np.diff(begin), ids

    def write(self, iterator: Iterator[pa.RecordBatch]) -> FilePart:
        system, path = file_system(self.path)
        part, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.ids"
        writer, stream = None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                system.create_dir(path, recursive=True)
                stream = system.open_output_stream(f"{path}/{name}.blocks")
                writer = PackedWriter(stream, self.bits, self.block_ids, self.id_kind)
            for doc_ids, lengths, ids in self._documents(batch):
                if len(ids) and int(ids.max()) >> self.bits:
                    raise ValueError(f"id {ids.max()} does not fit {self.bits} bits")
                writer.add(doc_ids, lengths, ids)
        if writer is None:
            return FilePart(part, "", 0, 0)
        head = writer.header()
        stream.close()
        self._with_header(system, f"{path}/{name}", head)
        return FilePart(part, name, writer.n_ids, sum(map(len, writer.doc_ids)))

    @staticmethod
    def _with_header(system: fs.FileSystem, path: str, head: bytes) -> None:
        """Put the header in front: in place on a local disk, by one more copy on an object store."""
        if isinstance(system, fs.LocalFileSystem):
            with open(f"{path}.blocks", "r+b") as file:
                file.write(head)
            system.move(f"{path}.blocks", path)
            return
        with system.open_input_stream(f"{path}.blocks") as old, system.open_output_stream(path) as new:
            old.read(HEADER)
            new.write(head)
            while piece := old.read(8 << 20):
                new.write(piece)
        system.delete_file(f"{path}.blocks")

    def commit(self, messages: list[FilePart | None]) -> None:
        system, path = file_system(self.path)
        files, before = [], 0
        for part in sorted((m for m in messages if m and m.n_docs), key=lambda m: m.part):
            files.append({**asdict(part), "before": before})
            before += part.n_ids
        manifest = {"version": VERSION, "bits": self.bits, "block_ids": self.block_ids, "n_ids": before, "files": files}
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/manifest.new") as stream:
            stream.write(json.dumps(manifest).encode())
        system.move(f"{path}/manifest.new", f"{path}/manifest.json")

    def abort(self, messages: list[FilePart | None]) -> None:
        system, path = file_system(self.path)
        for part in messages:
            if part and part.name:
                system.delete_file(f"{path}/{part.name}")


class PackedIdsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split_ids = int(options.get("split_ids", SPLIT_IDS))

    def partitions(self) -> list[DocumentRange]:
        system, path = file_system(self.path)
        found = []
        for entry in read_manifest(system, path)["files"]:
            cuts = max(1, min(entry["n_docs"], -(-entry["n_ids"] // self.split_ids)))
            edges = [entry["n_docs"] * k // cuts for k in range(cuts + 1)]
            found += [DocumentRange(entry["name"], entry["before"], a, b) for a, b in zip(edges, edges[1:])]
        return found or [DocumentRange("", 0, 0, 0)]

    def read(self, partition: DocumentRange) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, path = file_system(self.path)
        file = PackedFile(system, f"{path}/{partition.name}")
        starts, lo = file.starts, partition.lo
        while lo < partition.hi:
            hi = bisect_right(starts, starts[lo] + BATCH_IDS, lo + 2, partition.hi + 1) - 1
            ids = file.ids(int(starts[lo]), int(starts[hi]))
            cuts = pa.py_buffer(((starts[lo : hi + 1] - starts[lo]) * 4).astype(np.int32).tobytes())
            raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, cuts, pa.py_buffer(ids.astype("<u4").tobytes())])
            columns = [
                file.doc_ids.slice(lo, hi - lo),
                pa.array(starts[lo:hi] + partition.before),
                pa.array(np.diff(starts[lo : hi + 1])),
                raw,
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])
            lo = hi
        file.close()


def write_token_ids(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    file_ids: int = FILE_IDS,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode every whole text, add ``end_id``, and write the ids under ``path`` in ascending id order.

    Rows are dealt to tasks by ranges of the id and each task writes one file, of some ``file_ids`` ids at
    most. Rows of one id are dealt by their text and place, so an id that many rows share is no hot range.
    A text crosses the network once and only packed ids are written.

    Null or empty text is the end id alone. Null ids come first. Repeated rows are written as often as they
    come, in any order among themselves. An empty table makes a manifest without files. Other columns are
    ignored. Memory follows the longest text and 16 bytes for each document of a file.
    """
    spark = docs.sparkSession
    bits = bits_for(max(tokenizer_size(tokenizer), end_id + 1))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # A text of n bytes has n ids at most, and half of that is far above what any vocabulary here needs.
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(1, -(-total // (2 * file_ids)), min(shuffle, -(-total // BATCH_IDS)))
    order = ["doc_id", "_text", "_place"]
    rows = rows.select("*", F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_place"))
    rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    spark.dataSource.register(PackedIds)
    options = {"bits": bits, "block_ids": block_ids, "tokenizer": tokenizer, "end_id": end_id}
    rows.write.format(FORMAT).mode("append").options(**options).save(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document written under ``path``; ``start`` counts over all files."""
    spark.dataSource.register(PackedIds)
    return spark.read.format(FORMAT).load(path)
