"""Long repeated runs of words, by compacting the repeated part of a De Bruijn graph (operator 7)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import as_table, scratch_path
from .block_naming import row_keys
from .texts import Words, prefix_sums, slices, span_hashes, spans_to_mask, utf8, window_hashes, words

WIDTH = 35


@dataclass
class Nodes:
    """Chosen word k-mers of a run of rows: first word, row, and hashes of the k-mer and its two edges."""

    place: np.ndarray
    row: np.ndarray
    node: np.ndarray
    edges: np.ndarray
    first: np.ndarray


def node_words(width: int) -> tuple[int, int]:
    """Words in a node, and in the shorter gram that chooses it, so that every window holds a node."""
    short = max(1, min(4, width // 6))
    return (width + short + 1) // 2, short


def nodes(found: Words, width: int) -> Nodes:
    """The k-mers of which the smallest short gram comes first or last, of equal ones the leftmost.

    Whether a k-mer is chosen depends on its own words only, and any ``width`` words hold at least one
    of them: equal windows have the same nodes. An edge is the stretch from one node to the end of the
    next in its row; at either end of a row the edge is a fixed value.
    """
    long, short = node_words(width)
    n = len(found.starts)
    none = np.zeros(0, np.int64)
    if n < long:
        first = np.zeros(len(found.first), np.int64)
        return Nodes(none, none, none, none, first)
    sums = prefix_sums(found.word_hashes())
    grams = window_hashes(sums, short)
    bits = np.uint64(max(1, n).bit_length())
    keys = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least, covered, reach = keys, 1, long - short + 1
    while covered < reach:
        step = min(covered, reach - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    least = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = np.arange(len(least))
    chosen = (least == at) | (least == at + reach - 1)
    chosen &= found.row[: len(least)] == found.row[long - 1 :]
    place = np.flatnonzero(chosen)
    row = found.row[place]
    node = span_hashes(sums, place, place + long)
    after = np.full(len(place), 1, np.uint64)
    before = np.full(len(place), 2, np.uint64)
    pair = np.flatnonzero(row[1:] == row[:-1])
    edge = span_hashes(sums, place[pair], place[pair + 1] + long)
    after[pair], before[pair + 1] = edge, edge
    edges = (before << np.uint64(32)) | (after & np.uint64(0xFFFFFFFF))
    first = np.searchsorted(row, np.arange(len(found.first)))
    return Nodes(place, row, node.view(np.int64), edges.view(np.int64), first)


def _occurrences(width: int, placed: bool):
    """Node occurrences: with their edges, or with their row's key and their number in the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            data, offsets = utf8(b.column(1))
            for lo, hi in slices(offsets):
                within = offsets[lo : hi + 1] - offsets[lo]
                found = nodes(words(data[offsets[lo] : offsets[hi]], within), width)
                if placed:
                    index = np.arange(len(found.row)) - found.first[found.row]
                    columns = [found.node, keys[lo + found.row], index.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "row", "at"])
                else:
                    columns = [found.node, found.edges]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "edges"])

    return run


def _spans(width: int):
    """Spans that may repeat: compacted paths, and windows that lie in no single path."""
    long, _ = node_words(width)
    pairs = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))
    names = ["doc_id", "row", "n_words", "text", "whole", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(2))
            for lo, hi in slices(offsets):
                part, within = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                yield one(b.slice(lo, hi - lo), part, within)

    def one(b: pa.RecordBatch, part: np.ndarray, within: np.ndarray) -> pa.RecordBatch:
        found = words(part, within)
        known = nodes(found, width)
        n, n_rows = len(found.starts), b.num_rows
        marks = b.column(3)
        owner = np.repeat(np.arange(n_rows), marks.value_lengths().fill_null(0).to_numpy())
        flat = marks.flatten()
        index = known.first[owner] + flat.field("at").to_numpy()
        ok = index < known.first[owner + 1]
        flags = np.zeros(len(known.place), np.int8)
        flags[index[ok]] = flat.field("flags").to_numpy()[ok]
        repeated = flags > 0
        joins = repeated[:-1] & repeated[1:] & (known.row[:-1] == known.row[1:])
        joins &= ((flags[:-1] & 4) > 0) & ((flags[1:] & 2) > 0)
        head = np.flatnonzero(repeated & np.concatenate(([True], ~joins))[: len(repeated)])
        tail = np.flatnonzero(repeated & np.concatenate((~joins, [True]))[: len(repeated)])
        start, end = known.place[head], known.place[tail] + long
        enough = end - start >= width
        start, end = start[enough], end[enough]
        windows = max(0, n - width + 1)
        candidate = np.zeros(windows, bool)
        if windows:
            inside = spans_to_mask(start, end - width + 1, windows)
            fresh = np.zeros(n + 1, np.int64)
            fresh[known.place[~repeated] + 1] = 1
            fresh = np.cumsum(fresh)
            reach = width - long + 1
            candidate = (fresh[reach : reach + windows] == fresh[:windows]) & ~inside
            candidate &= found.row[:windows] == found.row[width - 1 :]
        alone = np.flatnonzero(candidate)
        start, end = np.concatenate((start, alone)), np.concatenate((end, alone + width))
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
        row = found.row[start] if len(start) else start
        # What stands for a span is the digest of its words as they are.
        flat, begin, stop = found.joined()
        cuts = zip(begin[start].tolist(), stop[end - 1].tolist())
        digests = b"".join(hashlib.sha256(flat[a:z]).digest()[:16] for a, z in cuts)
        h1, h2 = np.frombuffer(digests, np.int64).reshape(-1, 2).T
        fields = [h1, h2, (start - found.first[row]).astype(np.int32), (end - start).astype(np.int32)]
        spans = pa.StructArray.from_arrays([pa.array(x) for x in fields], fields=list(pairs.value_type))
        cuts = np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)
        touched = np.diff(cuts) > 0
        whole = []
        for k in np.flatnonzero(~touched):
            raw = part[within[k] : within[k + 1]].tobytes()
            whole.append((k, hashlib.sha256(b" ".join(raw.split())).hexdigest()))
        digest = [None] * n_rows
        for k, x in whole:
            digest[k] = x
        columns = [
            b.column(0),
            b.column(1),
            pa.array(np.diff(found.first)),
            b.column(2),
            pa.array(digest, pa.string()),
            pa.ListArray.from_arrays(pa.array(cuts), spans),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the words of confirmed spans."""
    for b in batches:
        data, offsets = utf8(b.column(2))
        kept, removed = [], []
        for k in range(b.num_rows):
            every = data[offsets[k] : offsets[k + 1]].tobytes().split()
            start, end = ([] if not b.column(c)[k].is_valid else b.column(c)[k].values.to_numpy() for c in (3, 4))
            gone = spans_to_mask(np.asarray(start, np.int64), np.asarray(end, np.int64), len(every))
            kept.append(b" ".join(w for w, g in zip(every, gone) if not g))
            removed.append(int(gone.sum()))
        columns = [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeated_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, digest: bool = False
) -> DataFrame:
    """Every document without the words covered by a ``width``-word window that occurs more than once.

    Nodes are word k-mers chosen by their own content, about one in eight words; edges lead from a node
    to the next. One aggregation counts every node and says whether all its occurrences agree on the
    edge before and the edge after. Joined back, a row's repeated nodes are compacted: neighbours belong
    to one path if the edge between them is the only one out of the first and into the second, so all
    occurrences of a path are whole and equal. Windows within a path repeat as the path does. Windows
    that cross from one path to another or beyond its end, and hold repeated nodes only, stand for
    themselves; no equal window can lie within a path. Paths and such windows are verified at their
    source coordinates: those removed have the same words, by 128 bits of their SHA-256, as another one.

    Returns doc_id, n_words, n_removed and kept (the remaining words, joined by one space), or with
    ``digest`` kept_sha256 instead, which saves writing the texts of documents without repeats.

    Null text has no words. Documents shorter than ``width`` words stay whole. Repeated rows are separate
    documents and so remove each other; null ids are kept. An empty table gives no rows; other columns
    are ignored. Keys of rows, nodes and edges are hashes of 64, 64 and 32 bits: a clash can hide a
    repeat, but cannot remove a word that does not repeat. Memory follows the longest text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), row_keys(id_col, text)[0].alias("row"), text.alias("text"))
    texts = rows.select("row", "text")
    counts = texts.mapInArrow(_occurrences(width, False), "node long, edges long").groupBy("node")
    counts = counts.agg(F.count("*").alias("n"), F.bit_and("edges").alias("every"), F.bit_or("edges").alias("any"))
    differ = F.col("every").bitwiseXOR(F.col("any"))
    one_before = F.shiftrightunsigned(differ, 32) == 0
    one_after = differ.bitwiseAND(F.lit(0xFFFFFFFF)) == 0
    flags = F.lit(1) + F.when(one_before, 2).otherwise(0) + F.when(one_after, 4).otherwise(0)
    # Written out, so that the join has an exchange of its own and can split a node that is everywhere.
    repeated = counts.where("n > 1").select("node", flags.cast("byte").alias("flags"))
    repeated = as_table(repeated, scratch_path(spark, "nodes"))
    placed = texts.mapInArrow(_occurrences(width, True), "node long, row long, at int")
    marks = placed.join(repeated, "node").groupBy("row").agg(F.collect_list(F.struct("at", "flags")).alias("marks"))
    schema = (
        f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row long, n_words long, text string, whole string, "
        "spans array<struct<h1: long, h2: long, start: int, n: int>>"
    )
    found = rows.join(marks, "row", "left").select("doc_id", "row", "text", "marks").mapInArrow(_spans(width), schema)
    touched = F.size("spans") > 0
    if digest:
        found = found.withColumn("text", F.when(touched, F.col("text")))
    found = as_table(found, scratch_path(spark, "spans"))
    every = found.where(touched).select("row", F.explode("spans").alias("span")).select("row", "span.*")
    twice = every.groupBy("h1", "h2", "n").agg(F.count("*").alias("times")).where("times > 1").drop("times")
    twice = as_table(twice, scratch_path(spark, "twice"))
    span = F.struct("start", (F.col("start") + F.col("n")).alias("end")).alias("span")
    gone = every.join(twice, ["h1", "h2", "n"], "left_semi").select("row", span)
    gone = gone.groupBy("row").agg(F.collect_set("span").alias("gone"))
    cut = found.where(touched).select("doc_id", "row", "n_words", "text")
    cut = cut.join(gone, "row", "left").select("doc_id", "n_words", "text", "gone.start", "gone.end")
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    cut = cut.mapInArrow(_cut, f"doc_id {id_kind}, n_words long, n_removed long, kept string")
    alone = found.where(~touched)
    zero = F.lit(0).cast("long").alias("n_removed")
    if digest:
        cut = cut.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")
        return cut.unionByName(alone.select("doc_id", "n_words", zero, F.col("whole").alias("kept_sha256")))
    joined = F.array_join(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), " ")
    return cut.unionByName(alone.select("doc_id", "n_words", zero, joined.alias("kept")))
