"""Document fingerprints that stay close when a text is edited: quartile bucket digests (operator 3)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .texts import SLICE_BYTES

BUCKETS = 256
LENGTH_STEP = 1.15
LENGTH_WEIGHT = 4
UNRELATED = 1.625 * BUCKETS
MOST_RANGES = 8192
TRIPLE = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def bucket_counts(parts: list[bytes]) -> np.ndarray:
    """How many byte triplets of each text fall in each bucket."""
    lengths = np.array([len(p) for p in parts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b"".join(parts), np.uint8)
    counts = np.zeros(len(parts) * BUCKETS, np.int64)
    for lo in range(0, max(0, len(data) - 2), SLICE_BYTES):
        part = data[lo : lo + SLICE_BYTES + 2].astype(np.uint32)
        mixed = part[:-2] * np.uint32(TRIPLE[0]) + part[1:-1] * np.uint32(TRIPLE[1]) + part[2:] * np.uint32(TRIPLE[2])
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        at = lo + np.arange(len(mixed))
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        key = row[inside] * BUCKETS + (mixed[inside] >> np.uint32(24))
        counts += np.bincount(key, minlength=len(counts))
    return counts.reshape(len(parts), BUCKETS)


def digests(parts: list[bytes]) -> np.ndarray:
    """One row per text: the code of its length, then for each bucket its quartile among the text's buckets."""
    if not parts:
        return np.zeros((0, BUCKETS + 1), np.uint8)
    counts = bucket_counts(parts)
    ranked = np.sort(counts, axis=1)
    out = np.zeros((len(parts), BUCKETS + 1), np.uint8)
    for q in (1, 2, 3):
        out[:, 1:] += counts > ranked[:, q * BUCKETS // 4 - 1][:, None]
    lengths = np.array([len(p) for p in parts], np.float64)
    out[:, 0] = np.minimum(255, np.floor(np.log1p(lengths) / np.log(LENGTH_STEP)))
    return out


def to_hex(found: np.ndarray) -> list[str]:
    """Two digits for the length, then one digit for two buckets."""
    packed = (found[:, 1::4] << 6) | (found[:, 2::4] << 4) | (found[:, 3::4] << 2) | found[:, 4::4]
    return [f"{n:02x}{row.tobytes().hex()}" for n, row in zip(found[:, 0], packed)]


def from_hex(fingerprint: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    codes = (packed[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3
    return np.concatenate(([int(fingerprint[:2], 16)], codes.ravel())).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for those that differ as much as unrelated ones or more.

    A bucket adds the distance of its quartiles, an opposite pair twice as much; the length adds its
    steps beyond the first.
    """
    apart = np.abs(a.astype(np.int16) - b)
    buckets = apart[..., 1:].sum(axis=-1) + 3 * (apart[..., 1:] == 3).sum(axis=-1)
    length = LENGTH_WEIGHT * np.maximum(0, apart[..., 0] - 1)
    return np.maximum(0.0, 1.0 - (buckets + length) / UNRELATED)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first of the next text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compare(id_kind: pa.DataType):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [id_kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        """Rows of (range, is_copy, doc_id, text) in order; each but the last has its next one beside it."""
        pairs = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
        own = digests([r[3].encode() for r in rows])
        changed = [edited(rows[k][3], rows[k + 1][3]).encode() for k in pairs]
        other, at = digests(changed), np.array(pairs, np.int64)
        columns = [
            [rows[k][2] for k in pairs],
            [len(rows[k][3]) for k in pairs],
            [hashlib.sha256(x).hexdigest() for x in changed],
            to_hex(own[at]),
            to_hex(other),
            likeness(own[at], other),
            likeness(own[at], own[at + 1]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for b in batches:
            columns = [b.column(k) for k in range(4)]
            for k in range(b.num_rows):
                row = (columns[0][k].as_py(), columns[1][k].as_py(), columns[2][k].as_py(), columns[3][k].as_py())
                waiting.append(row)
                size += len(row[3])
                if size > SLICE_BYTES:
                    yield compare(waiting)
                    waiting, size = waiting[-1:], len(waiting[-1][3])
        yield compare(waiting)

    return run


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text, and say how near both it and the next text are.

    The next document is the one with the next smaller id; after the smallest comes the largest. Texts
    cross the network once: ids are cut into ranges of about equal size, a range is read in id order, and
    the first document of each range is also sent to the end of the range before it. Only the range
    bounds and first ids, at most 8,192 of each, reach the driver.

    Null text counts as empty; an empty text has a fingerprint of zeros. Null ids come last. Rows with the
    same id are ordered by text, and each has a result. A single row follows itself. An empty table gives
    no rows. Other columns are ignored. A task holds about a megabyte of text, or one text if longer.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(8 * n, MOST_RANGES)
    steps = [k / ranges for k in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("doc_id", steps, 4 * MOST_RANGES).alias("cuts")).first()["cuts"]
    cuts = F.array(*[F.lit(x) for x in sorted(set(cuts or [0]))])
    place = F.coalesce(F.size(F.filter(cuts, lambda c: c > F.col("doc_id"))), F.lit(ranges))
    placed = rows.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(ranges)).otherwise(place))
    heads = sorted((r["range"], r["head"]) for r in placed.groupBy("range").agg(F.max("doc_id").alias("head")).collect())
    id_kind = rows.schema["doc_id"].dataType
    before = [heads[k - 1][0] for k in range(len(heads))]
    firsts = [(r, head, b) for (r, head), b in zip(heads, before)]
    firsts = spark.createDataFrame(firsts, f"range int, head {id_kind.simpleString()}, before int")
    copies = F.array(F.struct("range", F.lit(False).alias("copy")), F.struct(F.col("before").alias("range"), F.lit(True).alias("copy")))
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("head")), copies).otherwise(F.slice(copies, 1, 1))
    sent = placed.join(F.broadcast(firsts), "range").withColumn("_to", F.explode(copies))
    sent = sent.select("_to.range", "_to.copy", "doc_id", "text").repartition(n, "range")
    sent = sent.sortWithinPartitions("range", "copy", F.desc_nulls_last("doc_id"), "text")
    schema = (
        f"doc_id {id_kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return sent.mapInArrow(_compare(to_arrow_type(id_kind)), schema)
