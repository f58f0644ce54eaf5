"""Packing documents into windows of tokens: bounded-space online best fit (operator 10)."""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import as_table, scratch_path
from .texts import utf8

WINDOW = 2048
OPEN_WINDOWS = 64
END_ID = 1
# A word of letters that fold case one by one and stay as they are under NFC, then punctuation other than the
# apostrophe; or any other word.
PLAIN = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)|(.+))$", re.MULTILINE)
# The code of the part that holds the closing id alone.
CLOSING = 1

# Words and parts whose ids a worker remembers; a full memory is emptied and filled anew.
REMEMBERED = 1_000_000
BATCH_CHARS = 2 << 20


class WordEncoder:
    """Token ids of whole texts, put together from the ids of their words.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its
    words, in order. It also parts letters from the punctuation after them and folds case, so such
    a word is looked up as two parts. Each distinct part goes through the tokenizer once while it
    is remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {"": 0}
        self.word_parts = np.zeros((1, 2), np.int64)
        self.parts: dict[str, int] = {"": 0}
        self.ids = np.array([END_ID], np.uint32)
        self.start, self.length = np.array([0, 0]), np.array([0, 1])

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn_parts(self, letters: list[str], others: list[str]) -> None:
        """Runs of letters go through the tokenizer in chains; each ends with a piece that ends a word."""
        chains = [" ".join(letters[i : i + 256]) for i in range(0, len(letters), 256)]
        ids = np.fromiter(chain.from_iterable(map(self.whole, chains)), np.uint32)
        rest = [self.whole(w) for w in others]
        ends = np.concatenate((np.flatnonzero(self.ends_word[ids]) + 1, len(ids) + np.cumsum([0, *map(len, rest)])[1:]))
        ends = ends.astype(np.int64) + len(self.ids)
        starts = np.concatenate(([len(self.ids)], ends[:-1]))[: len(ends)]
        self.parts.update(zip(chain(letters, others), range(len(self.start), len(self.start) + len(ends))))
        self.ids = np.concatenate((self.ids, ids, np.fromiter(chain.from_iterable(rest), np.uint32)))
        self.start, self.length = np.append(self.start, starts), np.append(self.length, ends - starts)

    def learn(self, new: list[str]) -> None:
        letters, tails, odd = zip(*PLAIN.findall("\n".join(new)))
        letters = "\n".join(letters).lower().split("\n")
        tails = [a or b for a, b in zip(odd, tails)]
        self.learn_parts(list(set(letters).difference(self.parts)), list(set(tails).difference(self.parts)))
        codes = np.empty((len(new), 2), np.int64)
        for k, column in enumerate((letters, tails)):
            codes[:, k] = np.fromiter(map(self.parts.__getitem__, column), np.int64, len(new))
        self.words.update(zip(new, range(len(self.word_parts), len(self.word_parts) + len(new))))
        self.word_parts = np.concatenate((self.word_parts, codes))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text's followed by the closing id, and where each text begins."""
        if len(self.words) + len(self.parts) > REMEMBERED:
            self.clear()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.words)
        if new:
            self.learn(list(new))
        n_words = np.array([len(x) for x in split], np.int64)
        begin = np.concatenate(([0], np.cumsum(n_words)))
        codes = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64, begin[-1])
        parts = np.insert(self.word_parts[codes].ravel(), 2 * begin[1:], CLOSING)
        length = self.length[parts]
        ends = np.cumsum(length)
        place = np.repeat(self.start[parts] - (ends - length), length)
        place += np.arange(len(place))
        return self.ids[place], np.concatenate(([0], ends[2 * begin[1:] + np.arange(len(texts))]))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class OpenWindows:
    """A fixed number of windows being filled. ``put`` says which window and where in it.

    Best fit: the piece goes where the least room is left over. If it fits nowhere and no further
    window may be opened, the fullest is closed. Windows that fill up close by themselves.
    """

    def __init__(self, window: int, most: int, first: int):
        self.window, self.most, self.next = window, most, first
        self.free: list[tuple[int, int]] = []

    def put(self, length: int) -> tuple[int, int, list[int]]:
        """(window id, offset, ids of windows closed by this)."""
        closed = []
        at = bisect.bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if length < self.window and len(self.free) >= self.most:
                closed.append(self.free.pop(0)[1])
            room, window = self.window, self.next
            self.next += 1
        if room == length:
            closed.append(window)
        else:
            bisect.insort(self.free, (room - length, window))
        return window, self.window - room, closed


def _pieces_schema(id_type: str, ids: bool) -> str:
    return (
        f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + (", ids binary" if ids else "")
        + ", fill long"
    )


def _pack(path: str, window: int, most: int, keep_ids: bool, id_kind: pa.DataType):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    names += ["ids"] * keep_ids + ["fill"]
    kinds = [id_kind, *[pa.int64()] * 6, *[pa.binary()] * keep_ids, pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema=schema)

    def groups(batches):
        for b in batches:
            doc_ids = b.column(0)
            _, offsets = utf8(b.column(1))
            lo = 0
            while lo < len(doc_ids):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BATCH_CHARS, "right")) - 1)
                hi = min(hi, len(doc_ids))
                yield doc_ids.slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist()
                lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        windows = OpenWindows(window, most, TaskContext.get().partitionId() << 33)
        waiting: dict[int, list[tuple]] = {}
        for doc_ids, texts in groups(batches):
            ids, begin = encode([t or "" for t in texts])
            done = []
            for k, doc_id in enumerate(doc_ids):
                lo, hi = int(begin[k]), int(begin[k + 1])
                for a in range(lo, hi, window):
                    raw = ids[a : min(a + window, hi)].tobytes()
                    n = len(raw) // 4
                    where, offset, closed = windows.put(n)
                    row = (doc_id, a - lo, n, zlib.crc32(raw), hi - lo, where, offset)
                    row += (raw,) if keep_ids else ()
                    waiting.setdefault(where, []).append(row)
                    for w in closed:
                        done += [(*r, None) for r in waiting.pop(w)]
            yield batch(done)
        fill = {w: window - room for room, w in windows.free}
        yield batch([(*r, fill[w]) for w, rows in waiting.items() for r in rows])

    return run


def _merge(window: int, most: int):
    """Leftover windows, fullest first, packed whole into shared ones; a shared window has its first one's id."""
    schema = pa.schema([("sequence_id", pa.int64()), ("_into", pa.int64()), ("_shift", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, first = OpenWindows(window, most, 0), {}
        for b in batches:
            rows = []
            for sequence, fill in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                where, offset, _ = windows.put(fill)
                rows.append((sequence, first.setdefault(where, sequence), offset))
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    merge_share: int = 8192,
    ids: bool = True,
) -> DataFrame:
    """Cut documents into pieces of at most ``window`` tokens and lay them end to end in windows.

    Each task reads its rows once and keeps ``open_windows`` windows open: whole windows of a long
    document are closed at once, the rest goes to the window that it fills best, and when it fits none
    the fullest is closed. What is still open at the end of a task is merged with other tasks'
    leftovers, ``merge_share`` windows to a task, again by best fit.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    with ``ids`` the token ids as little-endian unsigned 32-bit integers.

    Null or empty text: one piece with the closing id only. Null ids are kept. Repeated rows are packed
    as often as they come. An empty table gives no rows. Other columns are ignored. Long texts: memory
    follows the longest text, not the partition. Windows depend on how the rows are split into tasks,
    never on timing: a lost task gives the same windows again, and the first pass is written out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    packer = _pack(tokenizer, window, open_windows, ids, to_arrow_type(id_type))
    first = rows.mapInArrow(packer, _pieces_schema(id_type.simpleString(), ids))
    first = as_table(first, scratch_path(spark, "pieces"))
    left = first.where("fill IS NOT NULL").groupBy("sequence_id").agg(F.first("fill").alias("fill"))
    shares = max(1, -(-left.count() // merge_share))
    left = left.repartition(shares, "sequence_id").sortWithinPartitions(F.desc("fill"), "sequence_id")
    moved = left.mapInArrow(_merge(window, 16 * open_windows), "sequence_id long, _into long, _shift long")
    joined = first.where("fill IS NOT NULL").join(moved, "sequence_id")
    columns = [c for c in first.columns if c != "fill"]
    place = {"sequence_id": F.col("_into"), "offset": F.col("offset") + F.col("_shift")}
    joined = joined.select(*[place.get(c, F.col(c)).alias(c) for c in columns])
    return first.where("fill IS NULL").select(*columns).unionByName(joined)
