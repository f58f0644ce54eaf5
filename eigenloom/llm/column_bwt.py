"""Repeated byte strings across documents, by column-wise construction of suffix orders (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .texts import BASE, BYTE_CODES, mix, powers, prefix_sums, run_starts, slices, span_hashes, spans_to_mask, utf8, window_hashes

WIDTH = 50
SEED = 18
SLICE = 2 << 20
BUCKET_BYTES = 4 << 20
CHUNK_BYTES = 48 << 20
ABSENT = 0xFF
NO_ID = -(1 << 63)


class Strings:
    """Stretches of documents that hold all windows sharing one seed, aligned on it.

    A window's seed is its SEED-byte string of smallest hash, the leftmost of equal ones; so equal windows
    have the same seed at the same place. ``lead`` is where the seed begins within the stretch and
    ``windows`` how many windows start in it.
    """

    KINDS = (("doc", np.int64), ("tag", np.uint16), ("start", np.int32), ("lead", np.uint8), ("windows", np.uint8))

    def __init__(self, doc, tag, start, lead, windows, content):
        self.doc, self.tag, self.start, self.lead, self.windows, self.content = doc, tag, start, lead, windows, content

    def __len__(self) -> int:
        return len(self.doc)

    def pack(self) -> bytes:
        columns = [np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.KINDS]
        return zstandard.ZstdCompressor(1).compress(b"".join([len(self).to_bytes(8, "little"), *columns, self.content]))

    @staticmethod
    def unpack(blobs: list[bytes]) -> Strings:
        columns, content = [[] for _ in Strings.KINDS], []
        for blob in blobs:
            raw = zstandard.ZstdDecompressor().decompress(blob)
            n, at = int.from_bytes(raw[:8], "little"), 8
            for column, (_, kind) in zip(columns, Strings.KINDS):
                column.append(np.frombuffer(raw, kind, n, at))
                at += n * np.dtype(kind).itemsize
            content.append(raw[at:])
        return Strings(*(np.concatenate(c) for c in columns), b"".join(content))


def seeded_runs(data: np.ndarray, offsets: np.ndarray, width: int):
    """(start, windows, seed place, seed hash) of every run of windows inside rows that share a seed."""
    reach = width - SEED + 1
    if len(data) < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    hashes = window_hashes(prefix_sums(BYTE_CODES[data]), SEED)
    bits = np.uint64(max(1, len(data)).bit_length())
    keys = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    least, covered = keys, 1
    while covered < reach:
        step = min(covered, reach - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(len(place), bool)
    lengths = np.diff(offsets)
    edge = np.zeros(len(place) + 1, np.int64)
    has = lengths >= width
    edge[offsets[:-1][has]] += 1
    np.add.at(edge, offsets[1:][has] - width + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    first = valid.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    start = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    windows = np.flatnonzero(last) - start + 1
    return start, windows, place[start], hashes[place[start]]


def short(seed: np.ndarray) -> np.ndarray:
    """40 bits of a seed's hash, others than those that choose its bucket."""
    return (seed >> np.uint64(20)) & np.uint64((1 << 40) - 1)


def bucket_of(seed: np.ndarray, buckets: int) -> np.ndarray:
    return (seed % np.uint64(1 << 20) % np.uint64(buckets)).astype(np.int64)


def cut_by(keys: np.ndarray) -> list[tuple[int, int]]:
    begin = run_starts(keys)
    return list(zip(begin.tolist(), [*begin[1:].tolist(), len(keys)]))


def _seeds(width: int, buckets: int):
    """(bucket, blob of seeds and documents), and (doc, seed) where a seed occurs twice in a slice.

    Of a seed's occurrences in a slice one travels, so a seed in a third of all documents is sent once a slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            data, offsets = utf8(b.column(2))
            for lo, hi in slices(offsets, SLICE):
                within = offsets[lo : hi + 1] - offsets[lo]
                start, _, _, seed = seeded_runs(data[offsets[lo] : offsets[hi]], within, width)
                if len(start):
                    yield from ship(seed, ids[lo + np.searchsorted(within, start, "right") - 1])

    def ship(seed: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((doc, seed))
        begin = run_starts(seed[order])
        sizes = np.diff(np.append(begin, len(order)))
        again = order[np.repeat(sizes > 1, sizes)]
        yield _known(doc[again], short(seed[again]))
        sent = np.sort(order[begin])
        bucket = bucket_of(seed[sent], buckets)
        sent, bucket = (x[np.argsort(bucket, kind="stable")] for x in (sent, bucket))
        parts, blobs = cut_by(bucket), []
        for x, y in parts:
            seeds = short(seed[sent[x:y]]).view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()
            steps = np.diff(doc[sent[x:y]], prepend=0)
            raw = (y - x).to_bytes(8, "little") + steps.view(np.uint8).reshape(-1, 8).T.tobytes() + seeds
            blobs.append(zstandard.ZstdCompressor(1).compress(raw))
        none = pa.nulls(len(parts), pa.int64())
        columns = [pa.array([int(bucket[x]) for x, _ in parts]), pa.array(blobs, pa.binary()), none, none]
        yield pa.RecordBatch.from_arrays(columns, schema=SEEDS)

    return run


SEEDS = pa.schema([("bucket", pa.int64()), ("blob", pa.binary()), ("doc", pa.int64()), ("seed", pa.int64())])


def _known(doc: np.ndarray, seed: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.binary())
    columns = [pa.array(doc), none, pa.array(doc), pa.array(seed.view(np.int64))]
    return pa.RecordBatch.from_arrays(columns, schema=SEEDS)


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, seed) of seeds that occur twice in a bucket. Blobs come in order of bucket.

    A bucket too large for memory goes in chunks; of each one occurrence of every seed is held.
    """
    bucket, held, size = None, [], 0

    def read(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        n = int(raw[:8].view(np.int64)[0])
        doc = np.cumsum(np.ascontiguousarray(raw[8 : 8 + 8 * n].reshape(8, n).T).view(np.int64).ravel())
        seed = np.zeros((n, 8), np.uint8)
        seed[:, :5] = raw[8 + 8 * n :].reshape(5, n).T
        return doc, seed.view(np.uint64).ravel()

    def settle() -> tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]:
        doc, seed = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(seed, kind="stable")
        begin = run_starts(seed[order])
        sizes = np.diff(np.append(begin, len(order)))
        again = order[np.repeat(sizes > 1, sizes)]
        return _known(doc[again], seed[again]), (doc[order[begin]], seed[order[begin]])

    for b in batches:
        known = b.column(1).is_null().to_numpy(zero_copy_only=False)
        if known.any():
            yield b.filter(pa.array(known))
        for k in np.flatnonzero(~known):
            here = b.column(0)[k].as_py()
            if held and (here != bucket or size > CHUNK_BYTES):
                found, rest = settle()
                yield found
                held, size = ([rest] if here == bucket else []), 0
            bucket = here
            held.append(read(b.column(1)[k].as_py()))
            size += 16 * len(held[-1][0])
    if held:
        yield settle()[0]


def _ship(width: int, buckets: int):
    """Strings with repeated seeds by bucket of their seed, and spans already known to repeat.

    Of equal strings in a slice only those of the smallest id travel; the others repeat for certain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, offsets = utf8(b.column(2))
            for lo, hi in slices(offsets, SLICE):
                part, within = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                seeds = b.column(3).slice(lo, hi - lo)
                yield from ship(part, within, ids[lo:hi], tags[lo:hi], seeds)

    def ship(part, within, ids, tags, seeds) -> Iterator[pa.RecordBatch]:
        start, windows, place, seed = seeded_runs(part, within, width)
        owner = np.searchsorted(within, start, "right") - 1
        wanted = np.unique(pair(np.repeat(np.arange(len(ids)), seeds.value_lengths().fill_null(0)), seeds.flatten().to_numpy().view(np.uint64)))
        stay = np.isin(pair(owner, short(seed)), wanted)
        start, windows, place, seed, owner = (x[stay] for x in (start, windows, place, seed, owner))
        if not len(start):
            return
        ends = start + windows + width - 1
        same = mix(span_hashes(prefix_sums(BYTE_CODES[part]), start, ends) + (place - start).astype(np.uint64))
        order = np.lexsort((ids[owner], same))
        begin = run_starts(same[order])
        first_id = np.repeat(ids[owner[order[begin]]], np.diff(np.append(begin, len(order))))
        later = np.zeros(len(start), bool)
        later[order] = ids[owner[order]] > first_id
        who = owner[later]
        yield _spans(ids[who], tags[who], start[later] - within[who], ends[later] - within[who])
        stay = ~later
        bucket = bucket_of(seed[stay], buckets)
        order = np.flatnonzero(stay)[np.argsort(bucket, kind="stable")]
        start, windows, place, owner, ends = (x[order] for x in (start, windows, place, owner, ends))
        bucket = np.sort(bucket)
        length = ends - start
        cuts = np.concatenate(([0], np.cumsum(length)))
        content = part[np.repeat(start - cuts[:-1], length) + np.arange(cuts[-1])].tobytes()
        parts, blobs = cut_by(bucket), []
        for x, y in parts:
            who = owner[x:y]
            columns = ids[who], tags[who], start[x:y] - within[who], (place - start)[x:y], windows[x:y]
            blobs.append(Strings(*columns, content[cuts[x] : cuts[y]]).pack())
        none = pa.nulls(len(parts), pa.int64())
        columns = [pa.array([int(bucket[x]) for x, _ in parts]), pa.array(blobs, pa.binary()), none, none, none, none]
        yield pa.RecordBatch.from_arrays(columns, schema=SPANS)

    def pair(row: np.ndarray, seed: np.ndarray) -> np.ndarray:
        return (row.astype(np.uint64) << np.uint64(40)) | seed

    return run


SPANS = pa.schema(
    [("bucket", pa.int64()), ("blob", pa.binary()), *((x, pa.int64()) for x in ("doc", "tag", "start", "end"))]
)


def _spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans found at one time, those of a document merged where they touch."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = (x[order].astype(np.int64) for x in (doc, tag, start, end))
    if len(doc):
        own = np.ones(len(doc), bool)
        own[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
        base = np.cumsum(own) * (int(end.max()) + 2)
        reach = np.maximum.accumulate(base + end)
        new = own.copy()
        new[1:] |= (base + start)[1:] > reach[:-1]
        begin = np.flatnonzero(new)
        end = reach[np.append(begin[1:], len(doc)) - 1] - base[begin]
        doc, tag, start = doc[begin], tag[begin], start[begin]
    columns = [pa.array(doc), pa.nulls(len(doc), pa.binary()), *(pa.array(x) for x in (doc, tag, start, end))]
    return pa.RecordBatch.from_arrays(columns, schema=SPANS)


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest of values[lo..hi], ends included, for each pair: two overlapping powers of two."""
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            step = 1 << (k - 1)
            table = np.minimum(table[:-step], table[step:])
        at = level == k
        if at.any():
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
    return out


def repeated_windows(columns: np.ndarray, doc: np.ndarray, width: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, column) of every window that also starts in a string of a smaller id.

    ``columns`` is one row per column, ABSENT where a string has none. From the last column to the first
    each string is lengthened by one symbol: a stable sort by it turns the order of the suffixes into
    that of the longer ones, and the common prefix of two neighbours grows by one from the least common
    prefix between them in the order before. Windows are equal where it is at least ``width``.
    """
    n = columns.shape[1]
    order, common = np.arange(n), np.zeros(n, np.uint8)
    who, where = [], []
    for c in range(len(columns) - 1, -1, -1):
        symbol = columns[c][order]
        turn = np.argsort(symbol, kind="stable")
        symbol = symbol[turn]
        follows = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] != ABSENT)) + 1
        longer = np.zeros(n, np.uint8)
        if len(follows):
            longer[follows] = range_minima(common, turn[follows - 1] + 1, turn[follows]) + 1
        order, common = order[turn], longer
        if c < reach:
            equal = common >= width
            if equal.any():
                begin = np.flatnonzero(~equal)
                size = np.diff(np.append(begin, n))
                least = np.repeat(np.minimum.reduceat(doc[order], begin), size)
                hit = order[doc[order] > least]
                who.append(hit)
                where.append(np.full(len(hit), c))
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(who), np.concatenate(where)


def _settle(found: Strings, width: int) -> tuple[tuple, Strings]:
    """Spans that repeat, and the strings of which some window is the first of its kind so far."""
    reach = width - SEED + 1
    total = reach - 1 + width
    length = found.windows.astype(np.int64) + width - 1
    cuts = np.concatenate(([0], np.cumsum(length)))
    column = reach - 1 - found.lead.astype(np.int64)
    content = np.frombuffer(found.content, np.uint8)
    grid = np.full((len(found), total), ABSENT, np.uint8)
    flat = np.repeat(np.arange(len(found)) * total + column - cuts[:-1], length) + np.arange(cuts[-1])
    grid.ravel()[flat] = content
    seed = np.zeros(len(found), np.uint64)
    for k in range(SEED):
        seed += BYTE_CODES[grid[:, reach - 1 + k]] * powers(BASE, SEED)[k]
    order = np.lexsort((found.doc, seed))
    begin = run_starts(seed[order])
    sizes = np.diff(np.append(begin, len(order)))
    last = np.append(begin[1:], len(order)) - 1
    shared = np.repeat(found.doc[order[begin]] != found.doc[order[last]], sizes)
    chosen = np.sort(order[shared])
    who, where = repeated_windows(np.ascontiguousarray(grid[chosen].T), found.doc[chosen], width, reach)
    who = chosen[who]
    start = found.start[who].astype(np.int64) + where - column[who]
    spans = (found.doc[who], found.tag[who], start, start + width)
    left = found.windows.astype(np.int64) - np.bincount(who, minlength=len(found)) > 0
    keep = np.flatnonzero(left)
    flat = np.repeat(cuts[keep] - np.concatenate(([0], np.cumsum(length[keep])))[:-1], length[keep])
    rest = content[flat + np.arange(len(flat))].tobytes()
    return spans, Strings(*(getattr(found, name)[keep] for name, _ in Strings.KINDS), rest)


def _match(width: int):
    """Blobs in bucket order to spans. A bucket too large for memory is settled in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size = None, [], 0

        def settle() -> tuple:
            return _settle(Strings.unpack(held), width)

        for b in batches:
            known = b.column(1).is_null().to_numpy(zero_copy_only=False)
            if known.any():
                yield b.filter(pa.array(known))
            for k in np.flatnonzero(~known):
                here, blob = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                if held and (here != bucket or size > CHUNK_BYTES):
                    spans, rest = settle()
                    yield _spans(*spans)
                    held = [rest.pack()] if here == bucket and len(rest) else []
                    size = 0
                bucket = here
                held.append(blob)
                size += zstandard.frame_content_size(blob)
        if held:
            yield _spans(*settle()[0])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Every document without the bytes covered by a ``width``-byte string that starts in a smaller id too.

    First the seeds of all windows meet, by a hash: most occur once, and their windows are done. A
    document's repeated seeds come back to it, and for each run of windows with one such seed the bytes
    that hold them are sent to the seed's bucket. A receiving task orders a bucket's strings column by
    column, one symbol of every string a round, and keeps only strings that hold the first known copy of
    some window, so a seed shared by a third of all documents needs no more memory than its distinct
    surroundings. Rounds are bounded by the string length (82 for 50-byte windows) instead of by the
    longest document. Equal seeds or strings of one slice are settled before anything is sent.

    Returns doc_id, n_bytes, kept (binary), removed (array of start and end of maximal spans).

    Null text counts as empty. Ids are integers; a null id is smaller than any other. Rows that repeat
    an id do not remove each other (they are told apart by 16 bits of a hash of the text). Texts shorter than ``width`` stay whole. An empty table gives no
    rows; other columns are ignored. A task's memory follows its longest text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    tag = F.xxhash64(text).bitwiseAND(F.lit(0xFFFF)).cast("int")
    rows = docs.select(order.alias("doc"), tag.alias("tag"), text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(1 << 20, max(1, -(-total // BUCKET_BYTES)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def by_bucket(sent: DataFrame) -> DataFrame:
        return sent.repartition(parts, "bucket").sortWithinPartitions("bucket")

    fields = "bucket long, blob binary, doc long, seed long"
    seeds = by_bucket(rows.mapInArrow(_seeds(width, buckets), fields)).mapInArrow(_twice, fields)
    seeds = seeds.groupBy("doc").agg(F.collect_list("seed").alias("seeds"))
    fields = "bucket long, blob binary, doc long, tag long, start long, end long"
    sent = rows.join(seeds, "doc", "left").where("seeds IS NOT NULL").select("doc", "tag", "text", "seeds")
    spans = by_bucket(sent.mapInArrow(_ship(width, buckets), fields)).mapInArrow(_match(width), fields)
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("tag", "start", "end")).alias("spans"))
    joined = rows.join(spans, "doc", "left")
    mine = F.filter("spans", lambda x: x["tag"] == F.col("tag")).alias("spans")
    joined = joined.select("doc", "text", mine).select("doc", "text", "spans.start", "spans.end")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            kept, removed = [], []
            for k in range(b.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                if not b.column(2)[k].is_valid:
                    kept.append(text.tobytes())
                    removed.append([])
                    continue
                start, end = (np.array(b.column(c)[k].values) for c in (2, 3))
                gone = spans_to_mask(start, end, len(text))
                kept.append(text[~gone].tobytes())
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                removed.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
            pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [b.column(0), pa.array(np.diff(offsets)), pa.array(kept, pa.binary()), pa.array(removed, pairs)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_bytes", "kept", "removed"])

    done = joined.mapInArrow(cut, "doc long, n_bytes long, kept binary, removed array<struct<start: long, end: long>>")
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return done.select(doc_id, "n_bytes", "kept", "removed")
